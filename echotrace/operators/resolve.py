"""Which of several matches of a message counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: matches that an earlier image doesn't replace (fixed values)
FIRM = ("url_hash", "forward_id", "forward_hash", "forward_text_hash", "video_sha256", "video_frame_hash", "video_metadata")


def resolve(messages: DataFrame, *, order: str, ts: str, url: DataFrame | None = None, forward: DataFrame | None = None, video: DataFrame | None = None, vector: DataFrame | None = None, image: DataFrame | None = None) -> DataFrame:
    """(order, matched_id, match_type) of the messages that have a match, from the matches (order, matched_id; forward and video also match_type) of each kind.

    A URL goes before a bundle, that before a video; a match by vector replaces any of them; one by image counts where there is none, or
    where the other isn't firm and came later than the image's."""
    rows = messages.select(order)
    kinds = {"url": (url, F.lit("url_hash")), "forward": (forward, F.col("match_type")), "video": (video, F.col("match_type")), "vector": (vector, F.lit("embedding")), "image": (image, F.lit("image_hash"))}
    hit = {}
    for name, (found, kind) in kinds.items():
        if found is None:
            hit[name] = F.lit(None).cast("struct<id: bigint, type: string>")
            continue
        rows = rows.join(found.select(order, F.struct(F.col("matched_id").cast("bigint").alias("id"), kind.alias("type")).alias(f"_{name}")), order, "left")
        hit[name] = F.col(f"_{name}")
    best = F.coalesce(hit["vector"], hit["url"], hit["forward"], hit["video"])
    rows = rows.select(order, best.alias("best"), hit["image"].alias("image")).filter("best is not null or image is not null")
    if image is not None:
        times = messages.select(F.col(order).alias("_id"), F.col(ts).alias("_t"))
        asked = F.col("image").isNotNull() & F.col("best").isNotNull() & ~F.col("best.type").isin(*FIRM)
        for side in ("best", "image"):
            rows = rows.join(times.select(F.col("_id").alias(f"_{side}_id"), F.col("_t").alias(f"_{side}_t")), F.when(asked, F.col(f"{side}.id")) == F.col(f"_{side}_id"), "left")
        earlier = F.coalesce(asked & (F.col("_image_t") < F.col("_best_t")), F.lit(False))
        rows = rows.withColumn("best", F.when(F.col("best").isNull() | earlier, F.col("image")).otherwise(F.col("best")))
    return rows.select(order, F.col("best.id").alias("matched_id"), F.col("best.type").alias("match_type"))
