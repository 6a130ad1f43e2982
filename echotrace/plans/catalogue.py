"""Every query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions import names
from echotrace.functions import text as X
from echotrace.functions.urls import fingerprint, normalised
from echotrace.operators import cells, context, filters, forwards, judging, prompts, repeats, routing, search, similar, video
from echotrace.operators import status as stored
from echotrace.plans import flow
from echotrace.streaming import sessions

DAY = repeats.DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repeat_verdict(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "props", "user_id", "ts")
    return repeats.repeat_verdicts(events, key=["event_type", "props"], order="event_id", ts="ts", sender="user_id", cooldown_s=DAY)


def repeat_sessions(spark, d):
    """Runs of a content's events with less than six hours between them."""
    found = sessions.repeat_sessions(table(spark, d, "events"), key=["event_type", "props"], ts="ts", sender="user_id", gap_s=6 * 3600)
    return found.filter("times > 1")


def repeat_first_seen(spark, d):
    return repeats.first_seen(table(spark, d, "events"), key=["event_type", "props"], order="event_id", ts="ts")


def text_exact_groups(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", "doc_id", F.sha2(X.squeeze(F.col("text")), 256).alias("text_hash"))
    return repeats.equal_groups(docs, key=["lang", "text_hash"], sender="source", order="doc_id")


def url_exact_groups(spark, d):
    """Each page's URL in six spellings; two of them carry a parameter of their own, escaped differently."""
    pages = table(spark, d, "pages").select("page_id", "url")
    mark = F.when(F.col("url").contains("?"), "&").otherwise("?")
    base = F.substring_index("url", "#", 1)
    with_ = lambda text: F.concat(base, mark, F.lit(text))
    scheme, host, rest = (F.regexp_extract(base, r"(?s)^(https?)://([^/?]*)(.*)$", k) for k in (1, 2, 3))
    port = F.when(scheme == "https", ":443").otherwise(":80")
    spellings = [F.col("url"), with_("utm_medium=app&fbclid=1#x"), F.concat(F.lit(" <"), F.upper(scheme), F.lit("://@"), F.upper(host), port, rest, F.lit("> ")), with_("zz=%2a%7e+%C3%A9&zy"), with_("&zy=&zz=*~%20é"), F.concat(scheme, F.lit("://me@"), host, rest)]
    every = pages.select("page_id", F.posexplode(F.array(*spellings)).alias("k", "url"))
    every = every.select((F.col("page_id") + F.col("k") * 1_000_000).alias("page_id"), (F.col("page_id") % 7).alias("sender"), fingerprint(normalised(F.col("url"))).alias("url_hash"))
    return repeats.equal_groups(every.filter("url_hash is not null"), key=["url_hash"], sender="sender", order="page_id").drop("url_hash")


def _bundles(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    keys = [F.concat_ws("-", "user_id", "props").alias("forward_id"), F.round("value", 2).cast("string").alias("forward_hash"), F.when(F.col("event_id") % 3 > 0, F.concat_ws("-", "user_id", day)).otherwise("").alias("forward_text_hash")]
    return table(spark, d, "events").select("event_id", "event_type", F.when(F.col("user_id") % 5 > 0, F.col("user_id").cast("string")).otherwise("").alias("sender"), *keys)


def forward_first_match(spark, d):
    return forwards.forward_matches(_bundles(spark, d), group="event_type", order="event_id")


def forward_unique_senders(spark, d):
    return forwards.senders_by_forward(_bundles(spark, d), group="event_type", order="event_id", sender="sender")


def forward_canonical_hash(spark, d):
    """Every conversation as a bundle, one more around it; and with each, a bundle around an expired one, one of media and one around a bundle that isn't there."""
    turns = table(spark, d, "conversations")
    node = F.struct(F.struct(F.col("role").alias("user_id"), F.upper("role").alias("nickname")).alias("sender"), F.array(F.struct(F.lit("text").alias("type"), F.struct("text").alias("data"))).alias("message"))
    inner = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("node")))), lambda x: x["node"]).alias("messages"))
    inner = inner.select(F.concat(F.lit("c"), "conv_id").alias("id"), F.to_json(F.struct(F.struct("messages").alias("data"))).alias("payload"), F.lit(False).alias("unavailable"))
    outer = turns.select("conv_id").distinct().select(F.concat(F.lit("o"), "conv_id").alias("id"), F.format_string('[{"user_id": 1, "name": " a  b ", "content": {"type": "forward", "data": {"id": "c%d"}}}]', "conv_id").alias("payload"), F.lit(False).alias("unavailable"))
    node = lambda who, *parts: '{"user_id": %s, "message": [%s]}' % (who, ", ".join(parts))
    forward = lambda name: '{"type": "forward", "data": {"id": "%s%%1$d"}}' % name
    seen = node(2, '{"data": {"text": " enough  to be seen by all "}, "type": "Text"}')
    more = {
        "x": f"[{node(1, forward('gone'))}, {seen}]", "t": f'{{"nodes": [{node(1, forward("nowhere"))}, {seen}]}}',
        "m": f"""{{"data": {{"nodeList": [{node(1, '{"type": "image", "data": {"file": "A%1$d.PNG?token=1"}}', '{"type": "video", "data": {"file_id": "F%1$d", "url": "u"}}', '{"type": "odd", "data": {"url": "u", "b": [1, {"Time": 2}], "a": null}}')}]}}}}""",
    }
    ids = turns.select("conv_id").distinct()
    for kind, text in more.items():
        outer = outer.unionByName(ids.select(F.concat(F.lit(kind), "conv_id").alias("id"), F.format_string(text, "conv_id").alias("payload"), F.lit(False).alias("unavailable")))
    gone = ids.select(F.concat(F.lit("gone"), "conv_id").alias("id"), F.lit(None).cast("string").alias("payload"), F.lit(True).alias("unavailable"))
    payloads = inner.unionByName(outer)
    out = forwards.expand_forwards(payloads.select(F.col("id").alias("forward_id")), payloads.unionByName(gone))
    return out.select("forward_id", "forward_hash", "forward_text_hash", "forward_node_count", "forward_truncated")


def semantic_best_match(spark, d):
    return similar.best_cosine(table(spark, d, "embeddings"), order="vec_id", vector="embedding", threshold=0.45)


def semantic_unique_senders(spark, d):
    return similar.senders_by_cosine(table(spark, d, "embeddings"), order="vec_id", vector="embedding", sender="label", threshold=0.40)


def _hashes(spark, d):
    e = F.col("embedding")
    bits = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda k: F.when(F.element_at(e, k) > F.element_at(e, k + 1), "1").otherwise("0"))
    return table(spark, d, "embeddings").select("vec_id", "label", similar.bits_of(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0")).alias("h"))


def dhash_pairs(spark, d):
    return similar.near_hashes(_hashes(spark, d), key="vec_id", bits="h", width=64, most=18).drop("g")


def image_best_match(spark, d):
    return similar.best_hash(_hashes(spark, d), order="vec_id", bits="h", group="label", threshold=0.70)


def image_unique_senders(spark, d):
    return similar.senders_by_hash(_hashes(spark, d).withColumn("sender", F.col("vec_id") % 11), order="vec_id", bits="h", sender="sender", group="label", threshold=0.65)


def _videos(spark, d):
    """Messages with a video or two: copies of forty films, by file, by frames that differ in some digits, by metadata."""
    v = F.col("vec_id")
    own = F.when(v % 3 == 0, 14).otherwise(5)
    frame = lambda k: F.concat(F.substr(F.sha2(F.concat(F.lit("v"), v.cast("string"), F.lit(f"-{k}")), 256), F.lit(1), own), F.substr(F.sha2(F.concat(F.lit("b"), (v % 40).cast("string"), F.lit(f"-{k}")), 256), own + 1))
    analysis = F.when(v % 5 == 0, "metadata").when(v % 5 == 1, "sha256").otherwise("perceptual")
    one = F.struct(F.when(v % 5 > 0, F.concat(F.lit("f"), (v % 60).cast("string"))).alias("sha256"), F.when(v % 5 > 1, F.array(*[frame(k) for k in range(5)])).otherwise(F.array().cast("array<string>")).alias("frame_hashes"), (10_000 + v % 4 * 400).alias("duration_ms"), names.metadata_hash(F.concat(F.lit("n"), (v % 30).cast("string")), v % 9).alias("metadata_hash"), analysis.alias("analysis"))
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") % 3).alias("label"), F.when(v % 7 > 0, (v % 7).cast("string")).otherwise("").alias("sender"), F.array(one).alias("videos"))


def video_tiered_match(spark, d):
    return video.video_matches(_videos(spark, d), group="label", order="vec_id")


def video_unique_senders(spark, d):
    return video.senders_by_video(_videos(spark, d), group="label", order="vec_id", sender="sender")


def size_diagnostics(spark, d):
    sizes = video.size_diagnostics(F.when(F.col("p_size") % 10 > 0, F.col("p_size") * 100), F.when(F.col("p_size") % 7 > 0, F.col("p_size") * 100 + (F.col("p_partkey") % 3 - 1) * 7))
    return table(spark, d, "part").select("p_partkey", sizes.alias("s")).select("p_partkey", "s.*")


def filename_normalise(spark, d):
    url = F.col("url")
    ways = F.array(url, F.concat(url, F.lit("/My%20Video+1.MP4?token=x")), F.concat(F.lit("C:\\dir\\A"), F.col("page_id").cast("string"), F.lit(".Mp4 ")), F.lit("data:video/mp4;base64,AAAA"), F.concat(F.lit("a/"), F.repeat(F.lit("x"), F.lit(600))))
    return table(spark, d, "pages").select("page_id", F.posexplode(F.transform(ways, names.file_name)).alias("way", "name"))


def modality_routing(spark, d):
    return routed(spark, d).select("page_id", "modality", "content", "image_source", "url_only", "url_hash", "has_video", "embedding_content")


def routed(spark, d):
    """Pages as messages of ten kinds."""
    k, n = F.col("page_id") % 10, F.col("page_id").cast("string")
    part = lambda type_, id_=None, path=None, url=None, file=None, readable=False: F.struct(F.lit(type_).alias("type"), _or_null(id_).alias("id"), _or_null(path).alias("path"), _or_null(url).alias("url"), _or_null(file).alias("file"), F.lit(readable).alias("readable"))
    _or_null = lambda c: c if c is not None else F.lit(None).cast("string")
    image = lambda name: part("Image", url=F.concat(F.lit(name), n))
    clip = part("Video", url=F.concat(F.lit("http://v/"), n))
    bundle = lambda id_: part("Forward", id_)
    kinds = [(2, [image("i"), image("j")]), (3, [image("s")]), (4, [image("s")]), (5, [clip, image("i")]), (6, [clip, bundle(F.concat(F.lit(" f"), n))]), (7, [bundle(F.lit(" "))]), (8, [bundle(F.repeat(F.lit("x"), F.lit(600)))])]
    components = F.lit(None).cast("array<struct<type:string,id:string,path:string,url:string,file:string,readable:boolean>>")
    for kind, parts in kinds:
        components = F.when(k == kind, F.array(*parts)).otherwise(components)
    raw = F.when(k == 5, F.array(F.struct(F.lit("video").alias("type"), F.create_map(F.lit("file"), F.concat(F.lit("A%20"), n, F.lit(".MP4")), F.lit("file_size"), n).alias("data"))))
    text = F.when(k.isin(0, 3, 4, 9), F.col("url")).when(k.isin(7, 8), F.lit("")).otherwise(F.concat(F.lit("　text "), n))
    text = F.when((k == 4) | (k == 8), F.lit("")).when(k == 9, F.concat(F.lit("see "), F.col("url"))).when(k == 7, F.concat(F.lit("t"), n)).otherwise(text)
    described = F.create_map(F.concat(F.lit("j"), n), F.concat(F.lit("cat "), n))
    expanded = [F.when(k == 6, F.concat(F.lit("[合并转发]\nx"), n)).alias("forward_content"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in forwards.EXPANDED.split(", ")) if c != "forward_content"]]
    messages = table(spark, d, "pages").select("page_id", (k % 3).cast("string").alias("group_id"), F.lit("u").alias("sender_id"), text.alias("text"), components.alias("components"), raw.alias("raw"), described.alias("described"), *expanded)
    out = routing.route(messages)
    return out.withColumn("embedding_content", routing.embedding_content(out))


WEEK = 7 * DAY


def forward_match_7d(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    return forwards.forward_matches(_bundles(spark, d).join(events, "event_id"), group="event_type", order="event_id", ts="ts", retention_s=WEEK)


def forward_senders_7d(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    return forwards.senders_by_forward(_bundles(spark, d).join(events, "event_id"), group="event_type", order="event_id", sender="sender", ts="ts", retention_s=WEEK)


def _hourly(rows):
    """A message an hour."""
    return rows.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 3600))


def semantic_match_7d(spark, d):
    return similar.best_cosine(_hourly(table(spark, d, "embeddings")), order="vec_id", vector="embedding", threshold=0.45, ts="ts", retention_s=WEEK)


def semantic_senders_7d(spark, d):
    return similar.senders_by_cosine(_hourly(table(spark, d, "embeddings")), order="vec_id", vector="embedding", sender="label", threshold=0.30, ts="ts", retention_s=WEEK)


def semantic_match_by_cells(spark, d):
    return cells.matches_by_cosine(table(spark, d, "embeddings"), order="vec_id", vector="embedding", threshold=0.40)


def semantic_senders_by_cells(spark, d):
    return cells.senders_by_cosine(_hourly(table(spark, d, "embeddings")), order="vec_id", vector="embedding", sender="label", threshold=0.30, ts="ts", retention_s=WEEK)


def image_match_7d(spark, d):
    return similar.best_hash(_hourly(_hashes(spark, d)), order="vec_id", bits="h", threshold=0.70, ts="ts", retention_s=WEEK)


def video_match_7d(spark, d):
    return video.video_matches(_hourly(_videos(spark, d)), group="label", order="vec_id", ts="ts", retention_s=WEEK)


def video_senders_7d(spark, d):
    return video.senders_by_video(_hourly(_videos(spark, d)), group="label", order="vec_id", sender="sender", ts="ts", retention_s=WEEK)


def longest_run(spark, d):
    return repeats.longest_runs(table(spark, d, "events"), group="event_type", value="user_id", order=["ts", "event_id"])


def context_around(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    return context.context_around(events, events.filter("event_id % 100 = 0"), group="event_type", order=["ts", "event_id"], mark="event_id", before=6, after=5)


def judge_context_stats(spark, d):
    return context.repeat_stats(table(spark, d, "events"), group=["event_type", "props"], ts="ts", sender="user_id", window_s=DAY, order="event_id")


def judge_window_stats(spark, d):
    stats = judging.judge_statistics(table(spark, d, "events"), group="event_type", order="event_id", ts="ts", sender="user_id", content="props", window_s=DAY)
    return stats.select("event_id", "messages_in_window", "exact_repeat_count", "exact_unique_senders", "exact_span_seconds", "longest_consecutive_exact")


def judge_contexts(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", "ts")
    first = repeats.any_key_match(events, group="event_type", keys=["user_id"], order="event_id").filter("event_id % 50 = 0").drop("match_type")
    return judging.judge_contexts(events, first, group="event_type", order="event_id", ts="ts", window_s=DAY).drop("place")


def judge_lines(spark, d):
    """What the judge is shown of each marked event's contexts, within 300 characters a part."""
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", "ts", "props")
    first = repeats.any_key_match(events, group="event_type", keys=["user_id"], order="event_id").filter("event_id % 50 = 0").drop("match_type")
    contexts = judging.judge_contexts(events, first, group="event_type", order="event_id", ts="ts", window_s=DAY)
    return prompts.context_lines(events, contexts, order="event_id", ts="ts", sender="user_id", content="props", most_chars=300)


def reminders(spark, d):
    """Events as messages with addresses, bundles, videos, or images with and without vectors: which of them come again, and is that worth flagging?"""
    n, none = F.col("event_id"), lambda kind: F.lit(None).cast(kind)
    part = lambda k, value: F.when(n % 4 == k, value)
    clip = F.struct(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("sha256"), F.array().cast("array<string>").alias("frame_hashes"), F.lit(0).cast("long").alias("duration_ms"), none("string").alias("metadata_hash"), F.lit("sha256").alias("analysis"))
    messages = table(spark, d, "events").select(
        n.alias("id"), F.col("event_type").alias("group_id"), "ts", F.col("user_id").cast("string").alias("sender_id"), F.col("props").alias("content"), part(0, F.sha2("props", 256)).alias("url_hash"), part(1, F.concat_ws("-", "user_id", "props")).alias("forward_id"),
        none("string").alias("forward_hash"), none("string").alias("forward_text_hash"), part(2, F.array(clip)).alias("videos"), part(3, F.unhex(F.substr(F.sha2("props", 256), F.lit(1), F.lit(4)))).alias("image_bits"), F.when(n % 8 == 7, F.array(F.lit(1.0), F.col("value") % 1.0)).alias("embedding"),
    )
    return flow.reminders(messages, semantic_from=0.9, min_senders=2)


def never_seen_before(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", "props", "ts")
    cut = F.lit("2024-01-20").cast("timestamp")
    return repeats.never_seen_before(events.filter(F.col("ts") >= cut), events.filter(F.col("ts") < cut), key=["event_type", "user_id", "props"]).select("event_id")


def store_status(spark, d):
    """Events as stored messages with up to two videos."""
    n, some = F.col("event_id"), lambda m, x: F.when(n % m == 0, x)
    clip = lambda m: F.struct(some(m, F.lit("s")).alias("sha256"), F.when(n % m == 1, F.array(F.lit("0"))).otherwise(F.array().cast("array<string>")).alias("frame_hashes"), F.when(n % m == 2, "metadata").otherwise("sha256").alias("analysis"))
    messages = table(spark, d, "events").select(
        F.col("event_type").alias("group_id"), some(2, F.array(F.lit(0.5))).alias("embedding"), (n % 3 == 0).alias("has_image"), some(6, F.lit("h")).alias("image_hash"), (n % 4 == 0).alias("has_video"), some(4, F.array(clip(8), clip(3))).alias("videos"),
        some(5, F.lit("f")).alias("forward_id"), some(10, F.lit("x")).alias("forward_hash"), some(15, F.lit("")).alias("forward_text_hash"), F.when(n % 20 == 0, True).alias("forward_partial"), (n % 7 == 0).alias("url_only"), some(14, F.lit("u")).alias("url_hash"),
    )
    return stored.status(messages)


def search_command(spark, d):
    turns = table(spark, d, "conversations")
    asked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" /搜图　"), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("搜图"), "text")).otherwise(F.lit("搜图"))
    return turns.select("conv_id", "turn", X.search_query(asked).alias("query"))


#: what hybrid_search asks for
ASKED, ASKED_VECTOR = "information about the", [1.0 if k % 3 == 0 else -0.5 for k in range(64)]


def hybrid_search(spark, d):
    """All documents, with vectors where they have one, by keywords, vector and letters."""
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    found = search.ranked(docs, ASKED, text="text", order="doc_id", recency="n_chars", fuzzy_from=0.65, vector="embedding", asked=ASKED_VECTOR, semantic_from=0.2)
    return found.select("doc_id", "match_type", F.round("semantic", 9).alias("semantic"), F.round("fuzzy", 9).alias("fuzzy"), "hits", "occurrences")


def recent_last_n(spark, d):
    return context.last_n(table(spark, d, "conversations").select("conv_id", "turn", "role"), group="conv_id", order=["turn"], n=2)


def ranked_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    return search.ranked(docs, "the by", text="text", order="doc_id", recency="n_chars").select("doc_id", "match_type", "hits", "occurrences")


def group_status(spark, d):
    has = lambda c: F.count_if(c).alias
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("messages"), F.countDistinct("user_id").alias("senders"), has(F.col("value") > 100)("large"), has(F.col("value") <= 0)("none"), F.countDistinct("props").alias("contents"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
    )


def day_shard_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("messages"))


def retention_window(spark, d):
    from echotrace.sources.messages import retained

    return retained(table(spark, d, "events"), ts="ts", now="2024-01-20 00:00:00", days=7).groupBy("event_type").agg(F.count("*").alias("messages"))


def filter_short_text(spark, d):
    return table(spark, d, "documents").filter(filters.long_enough(F.col("text"), 200)).select("doc_id", F.length("text").cast("long").alias("chars"))


def filter_commands(spark, d):
    turns = table(spark, d, "conversations")
    return turns.filter(~X.is_command(F.col("text"), ["the", "le", "of"])).select("conv_id", "turn")


def filter_regex(spark, d):
    return table(spark, d, "pages").filter(~X.fully_matches(F.col("url"), [r"https?://m\..*", "("])).select("page_id")


def filter_blocklist(spark, d):
    return filters.without_blocked(table(spark, d, "documents"), "source", ["src0", "src3"]).select("doc_id", "source")


def reminder_summary(spark, d):
    events = table(spark, d, "events")
    return events.select("event_id", X.summary(F.col("user_id").cast("string"), F.col("ts").cast("timestamp"), F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("props")).alias("summary"))


def metadata_hash(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", names.metadata_hash(names.file_name(F.concat(F.lit("/tmp/"), "p_name")), F.col("p_size")).alias("hash"))


_EARLIER = "(b.ts < a.ts or (b.ts = a.ts and b.event_id <= a.event_id))"
_NORMAL = r"trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'))"
_COMMAND = r"(?i)^[/!#.。]?(the|le|of)($|[\x09-\x0D\x20][^\n]*$)"
_BUNDLES = "select event_id, event_type, case when user_id % 5 > 0 then user_id::varchar else '' end sender, user_id || '-' || props forward_id, round(value, 2)::varchar forward_hash, case when event_id % 3 > 0 then user_id || '-' || strftime(ts, '%Y-%m-%d') else '' end forward_text_hash from events"
_HASHES = "select vec_id, label, list_sum([case when embedding[k] > embedding[k + 1] then 1::bigint << (63 - k)::bigint else 0 end for k in range(1, 64)])::bigint h from embeddings"
_VIDEOS = """
select vec_id, label % 3 label, case when vec_id % 7 > 0 then (vec_id % 7)::varchar else '' end sender, case when vec_id % 5 > 0 then 'f' || vec_id % 60 end sha, 10000 + vec_id % 4 * 400 ms, vec_id % 5 kind,
  case when vec_id % 9 > 0 then sha256('n' || vec_id % 30 || chr(10) || vec_id % 9) end meta,
  [substr(sha256('v' || vec_id || '-' || k), 1, case when vec_id % 3 = 0 then 14 else 5 end) || substr(sha256('b' || vec_id % 40 || '-' || k), case when vec_id % 3 = 0 then 15 else 6 end) for k in range(5)] f from embeddings"""
_SIMILAR = "[1 - list_sum([bit_count(xor(('0x' || substr(a.f[k], j * 8 + 1, 8))::bigint, ('0x' || substr(b.f[k], j * 8 + 1, 8))::bigint)) for j in range(8)]) / 256 for k in range(1, 6)]"
_VIDEO_PAIRS = f"""
with v as ({_VIDEOS}),
s as (select a.vec_id a, b.vec_id b, b.sender, coalesce(a.sha = b.sha, false) t0, a.kind = 0 and coalesce(a.meta = b.meta, false) t2, a.kind > 1 and b.kind > 1 and abs(a.ms - b.ms) <= greatest(1000, floor(greatest(a.ms, b.ms) * 0.03)) near, {_SIMILAR} x
  from v a join v b on a.label = b.label and b.vec_id <= a.vec_id),
p as (select *, near and x[1] + x[2] + x[3] + x[4] + x[5] >= 4.5 - 1e-9 and len([y for y in x if y >= 0.85]) >= 4 t1 from s)"""
_CONTEXTS = """
with e as (select *, row_number() over (partition by event_type order by ts, event_id) n from events),
m as (select event_id, event_type, ts, n, min(event_id) over (partition by event_type, user_id) matched_id from e),
k as (select m.*, f.n fn, (select min(x.n) from e x where x.event_type = m.event_type and x.ts >= m.ts - interval '1' day) w from m join e f on f.event_id = m.matched_id where m.event_id % 50 = 0 and m.matched_id < m.event_id)
select k.event_id mark, 'recent' part, e.event_id row_id from k join e using (event_type) where e.n between greatest(k.w, k.n - 12) and k.n - 1
union all select k.event_id, 'history', e.event_id from k join e using (event_type) where k.fn < k.w and e.n between k.fn - 6 and least(k.fn + 5, k.n - 1)"""
SQL = {
    "repeat_verdict": f"""
with p as (select a.event_id, a.user_id, a.ts, b.event_id mid, b.user_id mu, b.ts mts from events a join events b on a.event_type = b.event_type and a.props = b.props and {_EARLIER} and b.ts > a.ts - interval '7' day),
g as (select event_id, count(distinct mu) senders from p group by event_id),
f as (select * from (select p.*, row_number() over (partition by event_id order by mts, mid) rn from p where mid <> event_id) z where rn = 1)
select g.event_id, f.mid matched_id, g.senders unique_senders, case when f.mid is null then 'no_match' when f.mu = f.user_id then 'same_sender' when g.senders < 3 then 'few_senders' when f.ts < f.mts + interval '1' day then 'cooldown' else 'remind' end verdict
from g left join f on g.event_id = f.event_id""",
    "repeat_sessions": """
with b as (select *, coalesce(ts >= lag(ts) over (partition by event_type, props order by ts, event_id) + interval '6' hour, true) fresh from events),
s as (select *, sum(fresh::int) over (partition by event_type, props order by ts, event_id) n from b)
select event_type, props, epoch_us(min(ts)) started, epoch_us(max(ts)) + 21600000000 ended, count(*) times, count(distinct user_id) senders from s group by event_type, props, n having count(*) > 1""",
    "repeat_first_seen": "select event_type, props, arg_min(event_id, (ts, event_id)) event_id, count(*) times from events group by event_type, props",
    "text_exact_groups": f"select lang, sha256({_NORMAL}) text_hash, count(*) times, count(distinct source) senders, min(doc_id) first_id from documents group by all having count(*) > 1",
    "url_exact_groups": """
with u as (select page_id, split_part(url, '#', 1) u from pages),
n as (select page_id, split_part(u, '?', 1) h, list_sort([x for x in string_split(split_part(u, '?', 2), '&') if not (starts_with(x, 'utm_') or x = '')]) q from u),
both_ as (select page_id, unnest([0, 1, 2]) k, h || array_to_string(q, '&') n from n union all select page_id, unnest([3, 4]) k, h || array_to_string(list_concat(q, ['zy=', 'zz=%2A~+%C3%A9']), '&') from n)
select count(*) times, count(distinct page_id % 7) senders, min(page_id + k * 1000000) first_id from both_ group by n""",
    "forward_first_match": f"""
with e as ({_BUNDLES}),
p as (select event_id, 0 r, min(event_id) over (partition by event_type, forward_id) m from e union all select event_id, 1, min(event_id) over (partition by event_type, forward_hash) from e
  union all select event_id, 2, min(event_id) over (partition by event_type, forward_text_hash) from e where forward_text_hash <> ''),
h as (select event_id, arg_min(r, (m, r)) r, min(m) m from p where m < event_id group by 1)
select event_id, m matched_id, case r when 0 then 'forward_id' when 1 then 'forward_hash' else 'forward_text_hash' end match_type from h""",
    "forward_unique_senders": f"""
with e as ({_BUNDLES}),
p as (select a.event_id, b.sender from e a join e b on a.event_type = b.event_type and a.forward_id = b.forward_id and b.event_id <= a.event_id
  union all select a.event_id, b.sender from e a join e b on a.event_type = b.event_type and a.forward_hash = b.forward_hash and b.event_id <= a.event_id
  union all select a.event_id, b.sender from e a join e b on a.event_type = b.event_type and a.forward_text_hash = b.forward_text_hash and b.event_id <= a.event_id where a.forward_text_hash <> '')
select event_id, count(distinct sender) filter (sender <> '') unique_senders from p group by 1""",
    "forward_canonical_hash": """
with t as (select conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) t from conversations),
c as (select conv_id, count(*) n, sum(length(role) * 2 + length(t)) chars, sum(length(t)) visible, count(*) filter (t <> '') said,
  '[' || string_agg('{"segments":[{"text":' || to_json(t)::varchar || ',"type":"text"}],"sender_id":"' || role || '","sender_name":"' || upper(role) || '"}', ',' order by turn) || ']' nodes,
  '[' || string_agg('{"sender_id":"' || role || '","texts":[' || case when t = '' then '' else to_json(t)::varchar end || ']}', ',' order by turn) || ']' texts from t group by conv_id)
select 'c' || conv_id forward_id, sha256(nodes) forward_hash, case when visible >= 20 and said >= 2 then sha256(texts) end forward_text_hash, n forward_node_count, false forward_truncated from c
union all select 'o' || conv_id, sha256('[{"segments":[{"nodes":' || nodes || ',"type":"forward"}],"sender_id":"1","sender_name":"a b"}]'), null, n + 1, false from c
union all select 'x' || conv_id, sha256('[{"segments":[{"type":"forward","unreadable":true}],"sender_id":"1","sender_name":"1"},{"segments":[{"text":"enough to be seen by all","type":"text"}],"sender_id":"2","sender_name":"2"}]'), null, 2, false from c
union all select 't' || conv_id, null, null, 2, true from c
union all select 'm' || conv_id, sha256('[{"segments":[{"key":"file:a' || conv_id || '.png","type":"image"},{"key":"file_id:f' || conv_id || '","type":"video"},{"data_sha256":"' || sha256('{"a":null,"b":[1,{}]}') || '","type":"odd"}],"sender_id":"1","sender_name":"1"}]'), null, 1, false from c""",
    "semantic_best_match": """
with e as (select vec_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings),
p as (select a.vec_id, b.vec_id m, round(list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9), 9) s from e a join e b on b.vec_id < a.vec_id)
select vec_id, m matched_id, s similarity, s >= 0.45 matched from (select *, row_number() over (partition by vec_id order by s desc, m) r from p where s > 0) z where r = 1""",
    "semantic_unique_senders": """
with e as (select vec_id, label, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings)
select a.vec_id, count(distinct b.label) unique_senders from e a join e b on b.vec_id <= a.vec_id and round(list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9), 9) >= 0.40 group by 1""",
    "dhash_pairs": f"""
with e as ({_HASHES})
select a.vec_id a, b.vec_id b, bit_count(xor(a.h, b.h))::bigint distance from e a join e b on a.vec_id < b.vec_id where bit_count(xor(a.h, b.h)) <= 18""",
    "image_best_match": f"""
with e as ({_HASHES}),
p as (select a.vec_id, b.vec_id m, 1 - bit_count(xor(a.h, b.h)) / 64 s from e a join e b on a.label = b.label and b.vec_id < a.vec_id)
select vec_id, m matched_id, s similarity, s >= 0.70 matched from (select *, row_number() over (partition by vec_id order by s desc, m) r from p where s > 0) z where r = 1""",
    "image_unique_senders": f"""
with e as ({_HASHES})
select a.vec_id, count(distinct b.vec_id % 11) unique_senders from e a join e b on a.label = b.label and b.vec_id <= a.vec_id and 1 - bit_count(xor(a.h, b.h)) / 64 >= 0.65 group by 1""",
    "video_tiered_match": f"""{_VIDEO_PAIRS},
h as (select a, arg_min(b, (t, b)) m, min(t) t from (select a, b, case when t0 then 0 when t1 then 1 when t2 then 2 end t from p where b < a) z where t is not null group by a)
select a vec_id, m matched_id, ['video_sha256', 'video_frame_hash', 'video_metadata'][t + 1] match_type from h""",
    "video_unique_senders": f"""{_VIDEO_PAIRS}
select a vec_id, count(distinct sender) filter (sender <> '' and (t0 or t1 or t2)) unique_senders from p group by a""",
    "forward_match_7d": f"""
with e as (select e.*, v.ts from ({_BUNDLES}) e join events v using (event_id)),
p as (select a.event_id, b.event_id m, b.ts, case when a.forward_id = b.forward_id then 0 when a.forward_hash = b.forward_hash then 1 else 2 end r from e a join e b on a.event_type = b.event_type
  and (a.forward_id = b.forward_id or a.forward_hash = b.forward_hash or (a.forward_text_hash = b.forward_text_hash and a.forward_text_hash <> '')) and (b.ts < a.ts or (b.ts = a.ts and b.event_id < a.event_id)) and b.ts > a.ts - interval '7' day),
f as (select *, row_number() over (partition by event_id order by ts, m) n from p)
select event_id, m matched_id, ['forward_id', 'forward_hash', 'forward_text_hash'][r + 1] match_type from f where n = 1""",
    "forward_senders_7d": f"""
with e as (select e.*, v.ts from ({_BUNDLES}) e join events v using (event_id))
select a.event_id, count(distinct b.sender) filter (b.sender <> '') unique_senders from e a left join e b on a.event_type = b.event_type
  and (a.forward_id = b.forward_id or a.forward_hash = b.forward_hash or (a.forward_text_hash = b.forward_text_hash and a.forward_text_hash <> '')) and (b.ts < a.ts or (b.ts = a.ts and b.event_id <= a.event_id)) and b.ts > a.ts - interval '7' day group by 1""",
    "semantic_match_7d": """
with e as (select vec_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings),
p as (select a.vec_id, b.vec_id m, round(list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9), 9) s from e a join e b on b.vec_id < a.vec_id and b.vec_id > a.vec_id - 168)
select vec_id, m matched_id, s similarity, s >= 0.45 matched from (select *, row_number() over (partition by vec_id order by s desc, m) r from p where s > 0) z where r = 1""",
    "semantic_senders_7d": """
with e as (select vec_id, label, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings)
select a.vec_id, count(distinct b.label) unique_senders from e a join e b on b.vec_id <= a.vec_id and b.vec_id > a.vec_id - 168 and round(list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9), 9) >= 0.30 group by 1""",
    "semantic_match_by_cells": """
with e as (select vec_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings),
p as (select a.vec_id, b.vec_id m, round(list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9), 9) s from e a join e b on b.vec_id < a.vec_id)
select vec_id, m matched_id, s similarity from (select *, row_number() over (partition by vec_id order by s desc, m) r from p where s >= 0.40) z where r = 1""",
    "semantic_senders_by_cells": """
with e as (select vec_id, label, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings)
select a.vec_id, count(distinct b.label) unique_senders from e a join e b on b.vec_id <= a.vec_id and b.vec_id > a.vec_id - 168 and round(list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9), 9) >= 0.30 group by 1""",
    "image_match_7d": f"""
with e as ({_HASHES}),
p as (select a.vec_id, b.vec_id m, 1 - bit_count(xor(a.h, b.h)) / 64 s from e a join e b on b.vec_id < a.vec_id and b.vec_id > a.vec_id - 168)
select vec_id, m matched_id, s similarity, s >= 0.70 matched from (select *, row_number() over (partition by vec_id order by s desc, m) r from p where s > 0) z where r = 1""",
    "video_match_7d": f"""{_VIDEO_PAIRS},
h as (select a, arg_min(b, (t, b)) m, min(t) t from (select a, b, case when t0 then 0 when t1 then 1 when t2 then 2 end t from p where b < a and b > a - 168) z where t is not null group by a)
select a vec_id, m matched_id, ['video_sha256', 'video_frame_hash', 'video_metadata'][t + 1] match_type from h""",
    "video_senders_7d": f"""{_VIDEO_PAIRS}
select a vec_id, count(distinct sender) filter (sender <> '' and (t0 or t1 or t2)) unique_senders from p where b > a - 168 group by a""",
    "size_diagnostics": """
with p as (select p_partkey, case when p_size % 10 > 0 then p_size * 100 end d, case when p_size % 7 > 0 then p_size * 100 + (p_partkey % 3 - 1) * 7 end a from part)
select p_partkey, coalesce(d <> a, false) size_mismatch, a - d size_delta_bytes, round(a / d, 6) size_ratio from p""",
    "filename_normalise": r"""
with n as (select page_id, unnest(range(5)) way, lower(regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$')) f, url from pages)
select page_id, way::int way, case way when 0 then f when 1 then case when contains(url, '?') or contains(url, '#') then f else 'my video+1.mp4' end when 2 then 'a' || page_id || '.mp4' when 3 then '' else 'sha256-' || sha256(repeat('x', 600)) end as name from n""",
    "modality_routing": """
with b as (select page_id, page_id % 10 k, page_id::varchar n, trim(url) url, split_part(trim(url), '#', 1) u from pages),
q as (select *, list_sort([x for x in string_split(split_part(u, '?', 2), '&') if not (starts_with(x, 'utm_') or x = '')]) q from b),
m as (select *, case when k in (0, 1, 3, 7, 9) then 'text' when k = 2 then 'image' when k = 5 then 'video' when k = 6 then 'forward' end modality,
  case when k in (0, 3) then url when k = 1 then 'text ' || n when k = 7 then 't' || n when k = 9 then 'see ' || url when k = 2 then 'text ' || n || ' [图片内容: cat ' || n || ']' when k = 5 then 'text ' || n || ' [视频] a ' || n || '.mp4' when k = 6 then 'text ' || n || chr(10) || '[合并转发]' || chr(10) || 'x' || n end as content from q)
select page_id, modality, content, case when k = 2 then 'j' || n end image_source, k = 0 url_only, case when k = 0 then sha256(split_part(u, '?', 1) || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end) end url_hash,
  k = 5 has_video, case when k in (0, 6) then null when k = 5 then 'text ' || n else content end embedding_content from m""",
    "longest_run": """
with r as (select *, row_number() over (partition by event_type order by ts, event_id) n from events),
i as (select *, n - row_number() over (partition by event_type, user_id order by n) island from r)
select event_type, max(c) longest_run from (select event_type, count(*) c from i group by event_type, user_id, island) z group by event_type""",
    "context_around": """
with r as (select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) n from events)
select a.event_id center, b.event_id row_id, b.n - a.n "offset" from r a join r b on a.event_type = b.event_type and b.n between a.n - 6 and a.n + 5 where a.event_id % 100 = 0""",
    "judge_context_stats": f"""
select a.event_id, count(*) repeats, count(distinct b.user_id) senders, date_diff('microsecond', min(b.ts), any_value(a.ts)) // 1000000 span_s
from events a join events b on a.event_type = b.event_type and a.props = b.props and {_EARLIER} and b.ts >= a.ts - interval '1' day group by 1""",
    "judge_window_stats": f"""
with p as (select a.event_id, b.event_id bid, a.ts ats, b.ts, b.user_id, b.props = a.props same from events a join events b on a.event_type = b.event_type and {_EARLIER} and b.ts >= a.ts - interval '1' day),
i as (select *, row_number() over (partition by event_id order by ts, bid) - row_number() over (partition by event_id, same order by ts, bid) island from p),
r as (select event_id, max(c) longest from (select event_id, count(*) c from i where same group by event_id, island) z group by 1)
select event_id, count(*) messages_in_window, count(*) filter (same) exact_repeat_count, count(distinct user_id) filter (same) exact_unique_senders, date_diff('microsecond', min(ts) filter (same), any_value(ats)) // 1000000 exact_span_seconds, any_value(longest) longest_consecutive_exact from p join r using (event_id) group by 1""",
    "judge_contexts": _CONTEXTS,
    "judge_lines": f"""
with c as ({_CONTEXTS}),
x as (select mark, part, row_number() over (partition by mark, part order by ts, event_id) k, strftime(ts, '%m-%d %H:%M:%S') || ' ' || user_id || ': ' || props line from c join events on event_id = row_id),
y as (select *, sum(length(line) + 1) over (partition by mark, part order by k desc) <= 300 kept from x)
select mark, coalesce(string_agg(line, chr(10) order by k) filter (kept and part = 'recent'), '') recent, coalesce(string_agg(line, chr(10) order by k) filter (kept and part = 'history'), '') history, count(*) filter (not kept) left_out from y group by 1""",
    "reminders": """
with e as (select event_id id, event_type g, ts, user_id::varchar s, case when event_id % 4 = 0 then sha256(props) end u, case when event_id % 4 = 1 then user_id || '-' || props end f, case when event_id % 4 = 2 then 'f' || user_id % 40 end v,
  case when event_id % 4 = 3 then ('0x' || substr(sha256(props), 1, 4))::int end h, case when event_id % 8 = 7 then value % 1.0 end x from events),
p as (select a.id, b.id b, b.ts, b.s who, b.id <> a.id other, a.u = b.u u, a.f = b.f f, a.v = b.v v, 1 - bit_count(xor(a.h, b.h)) / 16 i, round((1 + a.x * b.x) / (sqrt(1 + a.x * a.x) * sqrt(1 + b.x * b.x) + 1e-9), 9) c
  from e a join e b on a.g = b.g and a.id % 4 = b.id % 4 and (b.ts < a.ts or (b.ts = a.ts and b.id <= a.id)) and b.ts > a.ts - interval '7' day),
k as (select id, b, ts, who, other, 'url_hash' kind, 1.0 score from p where u union all select id, b, ts, who, other, 'forward_id', 1.0 from p where f union all select id, b, ts, who, other, 'video_sha256', 1.0 from p where v
  union all select id, b, ts, who, other, 'image_hash', i from p where i >= 0.9 union all select id, b, ts, who, other, 'embedding', c from p where c >= 0.9),
m as (select id, kind, b, ts from (select *, row_number() over (partition by id, kind order by score desc, ts, b) r from k where other) z where r = 1),
n as (select id, kind, count(distinct who) senders from k group by 1, 2),
w as (select l.id, case when t.kind is null or (t.kind = 'embedding' and i.ts < t.ts) then i.kind else t.kind end kind from (select distinct id from m) l left join (select * from m where kind <> 'embedding' and kind <> 'image_hash' union all select * from m where kind = 'embedding') t on t.id = l.id left join (select * from m where kind = 'image_hash') i on i.id = l.id)
select e.id, m.b matched_id, m.kind match_type, coalesce(n.senders, 0) unique_senders, case when m.b is null then 'no_match' when o.s = e.s then 'same_sender' when n.senders < 2 then 'few_senders' when e.ts < o.ts + interval '1' hour then 'cooldown' else 'remind' end verdict
from e left join w on w.id = e.id left join m on m.id = w.id and m.kind = w.kind left join n on n.id = w.id and n.kind = w.kind left join e o on o.id = m.b""",
    "never_seen_before": "select event_id from events a where ts >= timestamp '2024-01-20' and not exists (select 1 from events b where b.ts < timestamp '2024-01-20' and a.event_type = b.event_type and a.user_id = b.user_id and a.props = b.props)",
    "store_status": """
select event_type group_id, count(*) messages, count(*) filter (event_id % 2 = 0) embedded, count(*) filter (event_id % 3 = 0) images, count(*) filter (event_id % 6 = 0) image_hashes, count(*) filter (event_id % 4 = 0) video_messages,
  count(*) filter (event_id % 8 = 0) + count(*) filter (event_id % 12 = 0) video_files, count(*) filter (event_id % 4 = 0 and event_id % 3 = 1) video_frames, count(*) filter (event_id % 4 = 0 and event_id % 3 = 2) video_metadata,
  count(*) filter (event_id % 5 = 0) forwards, count(*) filter (event_id % 10 = 0) forward_hashes, 0::bigint forward_text_hashes, count(*) filter (event_id % 20 = 0) forwards_partial, count(*) filter (event_id % 7 = 0) urls, count(*) filter (event_id % 14 = 0) url_hashes from events group by 1""",
    "search_command": r"select conv_id, turn, case turn % 3 when 0 then regexp_replace(text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') when 2 then '' end query from conversations",
    "recent_last_n": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations) z where n <= 2",
    "ranked_search": f"""
with d as (select doc_id, lower({_NORMAL}) t from documents)
select doc_id, case when contains(t, 'the by') then 'phrase' else 'keywords' end match_type, 2::bigint hits, ((length(t) - length(replace(t, 'the', ''))) // 3 + (length(t) - length(replace(t, 'by', ''))) // 2)::bigint occurrences from d where contains(t, 'the') and contains(t, 'by')""",
    "group_status": 'select event_type, count(*) messages, count(distinct user_id) senders, count(*) filter (value > 100) large, count(*) filter (value <= 0) "none", count(distinct props) contents, min(event_id) first_id, max(event_id) last_id from events group by 1',
    "day_shard_counts": "select event_type, ts::date::varchar as day, count(*) messages from events group by all",
    "retention_window": "select event_type, count(*) messages from events where ts > timestamp '2024-01-13 00:00:00' group by 1",
    "filter_short_text": "select doc_id, length(text)::bigint chars from documents where length(text) >= 200",
    "filter_commands": f"select conv_id, turn from conversations where not regexp_matches(trim(text), '{_COMMAND}')",
    "filter_regex": r"select page_id from pages where not regexp_full_match(url, 'https?://m\..*')",
    "filter_blocklist": "select doc_id, source from documents where source not in ('src0', 'src3')",
    "reminder_summary": """
with e as (select event_id, user_id, ts, props, floor(epoch(timestamp '2024-02-01 00:00:00'))::bigint - floor(epoch(ts))::bigint s from events)
select event_id, user_id || ' · ' || strftime(ts, '%m-%d %H:%M:%S') || '（' || case when s < 60 then s || '秒前' when s < 3600 then s // 60 || '分钟前' when s < 86400 then s // 3600 || '小时前' else s // 86400 || '天前' end || '）' || chr(10) || props summary from e""",
    "metadata_hash": "select p_partkey, sha256(lower(p_name) || chr(10) || p_size::varchar) hash from part",
}
#: the letters' similarity has no SQL; tests compare it with a plain loop
QUERIES = {name: globals()[name] for name in [*SQL, "hybrid_search"]}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
