"""From messages to reminders in one plan: filter, match by every kind, let one match count, count its senders, give the verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.operators import forwards, repeats, similar, video
from echotrace.operators.filters import long_enough
from echotrace.operators.resolve import resolve
from echotrace.operators.sliding import SECOND
from echotrace.shared import saved

FORWARD, VIDEO = ("forward_id", "forward_hash", "forward_text_hash"), ("video_sha256", "video_frame_hash", "video_metadata")


def reminders(
    messages: DataFrame, history: DataFrame | None = None, *, group: str = "group_id", order: str = "id", ts: str = "ts", sender: str = "sender_id", retention_s: int = 7 * repeats.DAY,
    min_senders: int = 3, cooldown_s: int = 3600, least_chars: int = 2, semantic_from: float = 0.85, image_from: float = 0.90, frames_from: float = 0.90,
) -> DataFrame:
    """(order, matched_id, match_type, unique_senders, verdict) of every message that is long enough or carries more than text.

    Messages have content, url_hash, forward_id, forward_hash, forward_text_hash, videos, embedding and image_bits (binary), null where they hold none.  Matches are
    looked for within the retention, in ``history`` too; of several, operators.resolve lets one count, and the senders are those of its kind."""
    carries = [F.col(c).isNotNull() for c in ("url_hash", "forward_id", "videos", "image_bits")]
    kept = messages.filter(long_enough(F.col("content"), least_chars) | reduce(lambda a, b: a | b, carries))
    kept = saved(kept, "messages")
    span = {"group": group, "order": order, "ts": ts, "retention_s": retention_s}
    whose = {**span, "sender": sender}
    has = lambda rows, *columns: None if rows is None else rows.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns]))
    of = lambda *columns: (has(kept, *columns), has(history, *columns))
    url, bundle, clip, vector, image = of("url_hash"), of(*forwards.KEYS), of("videos"), of("embedding"), of("image_bits")
    found = {
        "url": repeats.any_key_match(*url, keys=["url_hash"], **span).drop("match_type"), "forward": forwards.forward_matches(*bundle, **span), "video": video.video_matches(*clip, threshold=frames_from, **span),
        "vector": similar.best_cosine(*vector, vector="embedding", threshold=semantic_from, **span).filter("matched").select(order, "matched_id"), "image": similar.matches_by_hash(*image, bits="image_bits", threshold=image_from, **span).select(order, "matched_id"),
    }
    whole = kept.select(order, ts, sender) if history is None else kept.select(order, ts, sender).unionByName(history.select(order, ts, sender))
    match = saved(resolve(whole, order=order, ts=ts, **{k: saved(v, f"match-{k}") for k, v in found.items()}), "matches")
    counted = {
        "url": repeats.senders_by_any_key(*url, keys=["url_hash"], **whose), "forward": forwards.senders_by_forward(*bundle, **whose), "video": video.senders_by_video(*clip, threshold=frames_from, **whose),
        "vector": similar.senders_by_cosine(*vector, vector="embedding", threshold=semantic_from, **whose), "image": similar.senders_by_hash(*image, bits="image_bits", threshold=image_from, **whose),
    }
    kind = F.when(F.col("match_type") == "url_hash", "url").when(F.col("match_type").isin(*FORWARD), "forward").when(F.col("match_type").isin(*VIDEO), "video").when(F.col("match_type") == "embedding", "vector").otherwise("image")
    senders = reduce(DataFrame.unionByName, [rows.select(order, F.lit(k).alias("_kind"), "unique_senders") for k, rows in counted.items()])
    matched = match.withColumn("_kind", kind).join(senders, [order, "_kind"], "left").drop("_kind")
    first = whole.select(F.col(order).cast("bigint").alias("matched_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_first_at"), F.col(sender).alias("_first_sender"))
    rows = kept.select(order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(sender).alias("_me")).join(matched, order, "left").join(first, "matched_id", "left")
    gate = repeats.verdict(F.col("matched_id"), F.col("_first_sender") == F.col("_me"), F.coalesce("unique_senders", F.lit(0)), F.col("_at") < F.col("_first_at") + cooldown_s * SECOND, min_senders)
    return rows.select(order, "matched_id", "match_type", F.coalesce("unique_senders", F.lit(0)).cast("bigint").alias("unique_senders"), gate.alias("verdict"))
