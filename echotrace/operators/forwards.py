"""Forwarded bundles: expansion from a table of payloads, reuse of known ones, matches by three keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.functions.payloads import (
    BUNDLE, EMPTY, HASH_VERSION, INCOMPLETE, NESTED, NESTED_UNREADABLE, NOBODY, TEXT_CHARS, TEXT_NODES, UNAVAILABLE, Limits, is_object, node_of, nodes_of, parts_of, sender_of, with_segments,
)
from echotrace.functions.text import once
from echotrace.operators.repeats import any_key_match, senders_by_any_key
from echotrace.shared import saved

#: keys of a match, in their order
KEYS = ["forward_id", "forward_hash", "forward_text_hash"]
EXPANDED = (
    "forward_content string, forward_hash string, forward_text_hash string, forward_text_hash_eligible boolean, forward_node_count bigint, forward_truncated boolean, forward_partial boolean, "
    "forward_hash_version int, has_image boolean, has_video boolean"
)


def is_unavailable(error: Column) -> Column:
    """Whether a platform's error says that a bundle can't be read for good."""
    return F.coalesce(error.rlike(UNAVAILABLE), F.lit(False))


def parsed(payloads: DataFrame) -> DataFrame:
    """The payloads (id, payload JSON, unavailable) as rows, each parsed once: a row a bundle (``state``: read, unavailable or lost), a node and a segment."""
    known = payloads.filter("id is not null").groupBy("id").agg(F.first(F.struct("payload", F.coalesce("unavailable", F.lit(False)).alias("unavailable"))).alias("p"))
    read = once(once(known.select("id", "p.*"), v=F.try_parse_json("payload")), nodes=nodes_of(F.col("v"))).drop("v", "payload")
    bundles = read.select("id", F.lit("bundle").alias("what"), F.when(F.col("nodes").isNotNull(), "read").when(F.col("unavailable"), "unavailable").otherwise("lost").alias("state"))
    opened = once(read.select("id", F.posexplode("nodes").alias("n", "node")), v=node_of(F.col("node"))).drop("node").withColumn("known", is_object(F.col("v")))
    who, name = sender_of(F.col("v"))
    nodes = opened.select("id", F.lit("node").alias("what"), "n", "known", F.when(F.col("known"), who).alias("who"), F.when(F.col("known"), name).alias("name"))
    nodes = nodes.withColumn("chars", F.coalesce(F.length("who") + F.length("name"), F.lit(0)))
    parts = with_segments(opened.filter("known").select("id", F.lit("segment").alias("what"), "n", F.posexplode(parts_of(F.col("v"))).alias("s", "part")), "part")
    return bundles.unionByName(nodes, True).unionByName(parts, True)


def _level(level: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """What happens in the bundles (root, path, id, chain) of one depth, in rows (root, path, inst, id, what, ...).  ``path`` has the places on the way there, so that paths
    are in order as a reader meets them; ``inst`` is the bundle's own path."""
    at = level.select("root", F.col("path").alias("inst"), F.col("id").alias("_of"), "chain", F.array_contains("chain", F.col("id")).alias("_open"))
    met = at.join(known, F.col("_of") == F.col("id"), "left").filter("what is null or what = 'bundle' or not _open")
    state = F.when(F.col("_open"), "open").when(F.col("state") == "read", "read").when((F.col("state") == "unavailable") & F.lit(depth > 1), "unreadable").otherwise("lost")
    what = F.coalesce("what", F.lit("bundle"))
    place = F.concat("inst", F.filter(F.array("n", "s"), lambda x: x.isNotNull()))
    return met.select("root", place.alias("path"), "inst", F.col("_of").alias("id"), "chain", *[F.col(c) for c in known.columns if c not in ("id", "what", "state")], what.alias("what"), F.when(what == "bundle", state).alias("state"), F.lit(depth).alias("depth"))


def _within(events: DataFrame, limits: Limits) -> DataFrame:
    """The events that the budgets leave, and on all of them ``whole``: whether nothing was cut.  Budgets are spent in the order of paths: fetches only shut
    the bundles beyond them, nodes and segments end all, and so do characters, whose last text is shortened."""
    line = Window.partitionBy("root").orderBy("path")
    fetch = (F.col("what") == "bundle") & (F.col("state") != "open")
    rank = F.when(fetch, F.sum(fetch.cast("int")).over(line))
    events = events.withColumn("_fetch", F.max(rank).over(Window.partitionBy("root", "inst")))
    shut = F.coalesce(F.col("_fetch") > limits.fetches, F.lit(False))
    events = events.withColumn("state", F.when(shut, "shut").otherwise(F.col("state"))).filter(~shut | (F.col("what") == "bundle"))
    count = lambda what: F.sum((F.col("what") == what).cast("int")).over(line)
    events = events.withColumns({"_nodes": count("node"), "_segments": count("segment"), "_chars": F.sum(F.coalesce("chars", F.lit(0))).over(line)})
    over = (F.col("_nodes") > limits.nodes) | (F.col("_segments") > limits.segments)
    left = limits.chars - (F.col("_chars") - F.coalesce("chars", F.lit(0)))
    spent = F.col("_chars") > limits.chars
    lost = over | spent | ~F.coalesce("known", F.lit(True)) | F.coalesce(F.col("state").isin("open", "shut", "lost"), F.lit(False))
    events = events.withColumn("whole", ~F.max(lost).over(Window.partitionBy("root"))).filter(~over & ((left > 0) | ((F.col("what") == "bundle") & ~spent)))
    cut = lambda c, room: F.when(spent, F.substr(c, F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).otherwise(F.col(c))
    said = F.col("said").isNotNull()
    return events.withColumns({"name": cut("name", left - F.length("who")), "who": cut("who", left), "text": F.when(said, cut("text", left)).otherwise(F.col("text"))}).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit(NOBODY)))


def _written(events: DataFrame, depth: int, inner: DataFrame | None) -> DataFrame:
    """(root, id, json, text, nodes) of the bundles of a depth, given those of the next one: nodes has each node's sender and what it says."""
    here = events.filter(F.col("depth") == depth)
    parts = here.filter("what = 'segment'").select("root", "id", "n", "s", "json", "text", "said", "inner")
    if inner is None:
        parts = parts.withColumns({"_json": F.lit(None).cast("string"), "_text": F.lit(None).cast("string"), "_unread": F.lit(None).cast("boolean")})
    else:
        below = inner.select("root", F.col("id").alias("inner"), F.col("json").alias("_json"), F.col("text").alias("_text"), F.col("unread").alias("_unread"))
        parts = parts.join(below, ["root", "inner"], "left")
    nested = F.col("inner").isNotNull()
    json = F.when(nested & F.coalesce("_unread", F.lit(False)), '{"type":"forward","unreadable":true}').when(nested, F.concat(F.lit('{"nodes":'), F.coalesce("_json", F.lit("[]")), F.lit(',"type":"forward"}'))).otherwise(F.col("json"))
    text = F.when(nested & F.coalesce("_unread", F.lit(False)), NESTED_UNREADABLE).when(nested, F.concat(F.lit(NESTED), F.coalesce(F.concat(F.lit("\n"), F.nullif("_text", F.lit(""))), F.lit("")))).otherwise(F.col("text"))
    parts = parts.select("root", "id", "n", F.struct("s", json.alias("json"), F.nullif(text, F.lit("")).alias("text"), F.nullif("said", F.lit("")).alias("said")).alias("part"))
    held = parts.groupBy("root", "id", "n").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    nodes = here.filter("what = 'node' and who is not null").select("root", "id", "n", "who", "name").join(held, ["root", "id", "n"], "left").withColumn("parts", F.coalesce("parts", F.filter(F.array(F.struct(F.lit(0).alias("s"), *[F.lit("").alias(c) for c in ("json", "text", "said")])), lambda x: F.lit(False))))
    sender = F.substr(F.to_json(F.struct(F.col("who").alias("sender_id"), F.col("name").alias("sender_name"))), F.lit(2))
    form = F.concat(F.lit('{"segments":['), F.array_join(F.transform("parts", lambda p: p["json"]), ","), F.lit("],"), sender)
    line = F.concat("name", F.lit(": "), F.coalesce(F.nullif(F.array_join(F.transform("parts", lambda p: p["text"]), " "), F.lit("")), F.lit(EMPTY)))
    made = nodes.groupBy("root", "id").agg(F.array_sort(F.collect_list(F.struct("n", form.alias("form"), line.alias("line"), "who", F.array_compact(F.transform("parts", lambda p: p["said"])).alias("texts")))).alias("nodes"))
    bundles = here.filter("what = 'bundle' and state in ('read', 'unreadable')").select("root", "id", (F.col("state") == "unreadable").alias("unread"))
    joined = lambda field, by: F.array_join(F.transform("nodes", lambda x: x[field]), by)
    return bundles.join(made, ["root", "id"], "left").select("root", "id", "unread", F.concat(F.lit("["), F.coalesce(joined("form", ","), F.lit("")), F.lit("]")).alias("json"), F.coalesce(joined("line", "\n"), F.lit("")).alias("text"), "nodes")


def expand_forwards(bundles: DataFrame, payloads: DataFrame, *, limits: Limits = Limits(), sender_text: bool = True) -> DataFrame:
    """The stored form of every distinct forward_id of ``bundles``, from ``payloads`` (id, payload JSON, unavailable boolean).

    Payloads are parsed once each; bundles are opened level by level, one join each down to the depth that is allowed; a bundle that stands twice at a depth is opened once.  Every node and segment is a row in the order
    in which a reader meets it, so that budgets are running sums; then stable forms and texts are put together from the deepest level up.
    Ids without a payload, nesting too deep or within itself, and whatever goes beyond a budget give an incomplete bundle, which has no hash; broken JSON counts
    as no payload."""
    roots = bundles.select("forward_id").filter("forward_id <> ''").distinct()
    known = saved(parsed(payloads), "payloads")
    level = roots.select(F.col("forward_id").alias("root"), F.array().cast("array<int>").alias("path"), F.col("forward_id").alias("id"), F.array().cast("array<string>").alias("chain"))
    events = None
    for depth in range(1, limits.depth + 1):
        here = saved(_level(level, known, depth), "bundles")
        events = here if events is None else events.unionByName(here)
        first = F.row_number().over(Window.partitionBy("root", "inner").orderBy("path"))
        level = here.filter("inner is not null").withColumn("_first", first).filter("_first = 1").select("root", "path", F.col("inner").alias("id"), F.array_append("chain", F.col("id")).alias("chain"))
    # nesting beyond the depth that is allowed
    events = events.withColumn("known", F.col("known") & ((F.col("depth") < limits.depth) | F.col("inner").isNull()))
    kept = saved(_within(events, limits), "kept")
    forms = None
    for depth in range(limits.depth, 0, -1):
        forms = _written(kept, depth, forms)
        if depth > 1:
            forms = saved(forms, "forms")
    forms = forms.select("root", "json", "text", "nodes")
    unread = F.coalesce(F.col("state") == "unreadable", F.lit(False))
    counts = kept.groupBy("root").agg(
        F.bool_and("whole").alias("whole"), F.count_if(F.col("what") == "node").alias("n"), F.coalesce(F.sum(F.length("said")), F.lit(0)).alias("visible"), F.count_if("stable").alias("stable"), F.coalesce(F.bool_or(unread), F.lit(False)).alias("partial"),
        F.coalesce(F.bool_or(F.col("medium") == "image"), F.lit(False)).alias("has_image"), F.coalesce(F.bool_or(F.col("medium") == "video"), F.lit(False)).alias("has_video"),
    )
    rows = counts.join(forms, "root", "left")
    told = F.col("whole") & (F.size("nodes") > 0) & (~F.col("partial") | (F.col("visible") >= limits.visible_chars) | (F.col("stable") > 0))
    speak = F.size(F.filter("nodes", lambda x: F.size(x["texts"]) > 0))
    eligible = F.col("whole") & (F.col("visible") >= TEXT_CHARS) & (speak >= TEXT_NODES)
    said = F.to_json(F.transform("nodes", lambda x: F.struct(x["who"].alias("sender_id"), x["texts"].alias("texts"))))
    content = F.concat_ws("\n", F.lit(BUNDLE), F.nullif("text", F.lit("")), F.when(~F.col("whole"), INCOMPLETE))
    return rows.select(
        F.col("root").alias("forward_id"), content.alias("forward_content"), F.when(F.coalesce(told, F.lit(False)), F.sha2("json", 256)).alias("forward_hash"), F.when(F.coalesce(eligible, F.lit(False)) & F.lit(sender_text), F.sha2(said, 256)).alias("forward_text_hash"),
        F.coalesce(eligible, F.lit(False)).alias("forward_text_hash_eligible"), F.col("n").alias("forward_node_count"), (~F.col("whole")).alias("forward_truncated"), F.col("partial").alias("forward_partial"), F.lit(HASH_VERSION).alias("forward_hash_version"), "has_image", "has_video",
    )


def known_forwards(history: DataFrame, *, group: str, order: str, sender_text: bool = True) -> DataFrame:
    """Of each group and forward_id, the first stored message, where what it holds can be used again: made by today's rules, with the text
    hash decided where it is asked for, and with a hash or at least complete."""
    columns = [c.split()[0] for c in EXPANDED.split(", ")]
    first = history.filter(F.coalesce(F.col("forward_id"), F.lit("")) != "").groupBy(group, "forward_id").agg(F.min_by(F.struct(*columns, "content"), order).alias("m"))
    decided = (F.coalesce("m.forward_text_hash", F.lit("")) != "") | F.coalesce(~F.col("m.forward_text_hash_eligible"), F.lit(False)) if sender_text else F.lit(True)
    whole = (F.coalesce("m.forward_hash", F.lit("")) != "") | ~F.coalesce("m.forward_truncated", F.lit(False))
    content = F.coalesce(F.nullif("m.forward_content", F.lit("")), F.nullif("m.content", F.lit("")), F.lit("[合并转发消息]"))
    usable = first.filter(decided & whole & (F.col("m.forward_hash_version") == HASH_VERSION))
    own = {"forward_content": content, "forward_text_hash": F.col("m.forward_text_hash") if sender_text else F.lit(None).cast("string")}
    return usable.select(group, "forward_id", *[own.get(c, F.col(f"m.{c}")).alias(c) for c in columns])


def forward_matches(messages: DataFrame, history: DataFrame | None = None, *, group: str, order: str, ts: str | None = None, retention_s: int | None = None) -> DataFrame:
    """(order, matched_id, match_type): the earliest earlier bundle of the group within the retention with the same id, content or senders' texts."""
    return any_key_match(messages, history, group=group, keys=KEYS, order=order, ts=ts, retention_s=retention_s)


def senders_by_forward(messages: DataFrame, history: DataFrame | None = None, *, group: str, order: str, sender: str, ts: str | None = None, retention_s: int | None = None) -> DataFrame:
    """(order, unique_senders) over bundles within the retention that share any of the three keys."""
    return senders_by_any_key(messages, history, group=group, keys=KEYS, order=order, sender=sender, ts=ts, retention_s=retention_s)
