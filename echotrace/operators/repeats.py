"""What earlier content of its group a message repeats, who else sent it, and whether that is worth flagging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.operators.sliding import SECOND, coded, meet, moment, sender_counts, with_history
from echotrace.shared import saved

DAY = 86_400


def verdict(matched: Column, same_sender: Column, senders: Column, too_soon: Column, min_senders: int, judged: Column | None = None) -> Column:
    """The gate, in its order: no_match, same_sender, few_senders, cooldown, judged_no, remind.  ``judged`` is a provider's answer; none counts as no."""
    gate = F.when(matched.isNull(), "no_match").when(same_sender, "same_sender").when(senders < min_senders, "few_senders").when(too_soon, "cooldown")
    if judged is not None:
        gate = gate.when(~F.coalesce(judged, F.lit(False)), "judged_no")
    return gate.otherwise("remind")


def look_back(messages: DataFrame, history: DataFrame | None = None, *, key: list[str], order: str, ts: str, sender: str, window_us: int) -> DataFrame:
    """For every message, over the rows of its key at or before it by (ts, order) and less than ``window_us`` older, itself included:
    order, _me, _at, seen, senders (distinct, null ones left out) and first, the earliest of them: struct (at, id, sender).

    No pairs are made.  A row adds to the counts when it comes and takes away when it leaves the window, a sender's only where no other
    row of that sender follows in time; what leaves also names the row that is first from then on.  Running sums over both kinds of
    events do the rest.  Time is cut into spans of a window's length and rows also go to the next span, so that a key that never
    ends is dealt over the spans."""
    at = F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")
    columns = [*key, F.col(order).alias("_id"), at, F.col(sender).alias("_sender")]
    rows = messages.select(*columns, F.lit(True).alias("_now"))
    if history is not None:
        rows = rows.unionByName(history.select(*columns, F.lit(False).alias("_now")))
    span = F.floor(F.col("_at") / window_us)
    rows = rows.withColumn("_span", F.explode(F.array(span, span + 1))).withColumn("_now", F.col("_now") & (F.col("_span") == span))
    run = [*key, "_span"]
    mine = Window.partitionBy(*run, "_sender").orderBy("_at", "_id")
    line = Window.partitionBy(*run).orderBy("_at", "_id")
    came, next_ = F.lag("_at").over(mine), F.lead("_at").over(mine)
    rows = rows.repartition(*run).withColumns(
        {
            "_new": (F.col("_sender").isNotNull() & (came.isNull() | (came <= F.col("_at") - window_us))).cast("long"),
            "_last": (F.col("_sender").isNotNull() & (next_.isNull() | (next_ >= F.col("_at") + window_us))).cast("long"),
            "_after": F.lead(F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"), F.col("_sender").alias("sender"))).over(line),
            "_start": F.first(F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"), F.col("_sender").alias("sender"))).over(line.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    comes = F.struct(F.col("_at").alias("time"), F.lit(1).alias("kind"), F.col("_new").alias("senders"), F.lit(1).cast("long").alias("rows"), F.lit(None).cast(rows.schema["_after"].dataType).alias("after"))
    goes = F.struct((F.col("_at") + window_us).alias("time"), F.lit(0).alias("kind"), (-F.col("_last")).alias("senders"), F.lit(-1).cast("long").alias("rows"), F.col("_after").alias("after"))
    events = rows.withColumn("_event", F.explode(F.array(goes, comes)))
    upto = Window.partitionBy(*run).orderBy("_event.time", "_event.kind", "_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = events.withColumns({"senders": F.sum("_event.senders").over(upto), "seen": F.sum("_event.rows").over(upto), "first": F.coalesce(F.last("_event.after", True).over(upto), F.col("_start"))})
    return sums.filter((F.col("_event.kind") == 1) & F.col("_now")).select(F.col("_id").alias(order), F.col("_sender").alias("_me"), "_at", "seen", "senders", "first")


def repeat_verdicts(messages: DataFrame, history: DataFrame | None = None, *, key: list[str], order: str, ts: str, sender: str, retention_s: int = 7 * DAY, min_senders: int = 3, cooldown_s: int = 3600) -> DataFrame:
    """(order, matched_id, unique_senders, verdict) for every message, against what precedes it by (ts, order) within the retention:
    the other messages and, if given, an earlier ``history``.  A null in the key matches nothing."""
    keyed = reduce(lambda a, c: a & F.col(c).isNotNull(), key, F.lit(True))
    found = look_back(messages.filter(keyed), history.filter(keyed) if history is not None else None, key=key, order=order, ts=ts, sender=sender, window_us=retention_s * SECOND)
    matched = F.col("first.id") != F.col(order)
    gate = verdict(F.when(matched, 1), F.col("first.sender") == F.col("_me"), F.col("senders"), F.col("_at") < F.col("first.at") + cooldown_s * SECOND, min_senders)
    out = found.select(order, F.when(matched, F.col("first.id")).alias("matched_id"), F.col("senders").alias("unique_senders"), gate.alias("verdict"))
    alone = messages.filter(~keyed).select(order, F.lit(None).cast(out.schema["matched_id"].dataType).alias("matched_id"), F.col(sender).isNotNull().cast("long").alias("unique_senders"), F.lit("no_match").alias("verdict"))
    return out.unionByName(alone)


def first_seen(messages: DataFrame, *, key: list[str], order: str, ts: str) -> DataFrame:
    """(key, order): the first message of each content; the rest repeat it."""
    first = messages.groupBy(*key).agg(F.min_by(order, F.struct(ts, order)).alias(order), F.count("*").alias("times"))
    return first.select(*key, order, "times")


def never_seen_before(messages: DataFrame, earlier: DataFrame, *, key: list[str]) -> DataFrame:
    """Messages whose content no earlier one has; a null in the key is never seen."""
    return messages.join(earlier.select(*key).distinct(), key, "left_anti")


def equal_groups(messages: DataFrame, *, key: list[str], sender: str, order: str) -> DataFrame:
    """Contents that came more than once: how often, from how many senders, first where."""
    return messages.groupBy(*key).agg(F.count("*").alias("times"), F.countDistinct(sender).alias("senders"), F.min(order).alias("first_id")).filter("times > 1")


def _under_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key that a message has: _kind is the key's place among ``keys``; _alone: it has no other."""
    each = F.filter(F.array(*[F.struct(F.lit(n).alias("_kind"), F.col(k).cast("string").alias("_key")) for n, k in enumerate(keys)]), lambda x: x["_key"] != "")
    kept = rows.withColumn("_each", each).withColumn("_alone", F.size("_each") == 1)
    return kept.select("_g", "_at", "_id", F.col("_now").alias("_asks"), "_alone", *[c for c in ("_code",) if c in rows.columns], F.inline("_each"))


def any_key_match(messages: DataFrame, history: DataFrame | None = None, *, group: str, keys: list[str], order: str, ts: str | None = None, retention_s: int | None = None) -> DataFrame:
    """(order, matched_id, match_type): the earliest earlier row within the retention that shares any key, and the first key, in their order, that it shares.

    Rows of ``history`` are matched with, but match nothing themselves.  ``order`` is a whole number; null and empty keys match nothing; see operators.sliding."""
    columns = [F.col(group).alias("_g"), moment(ts, order).alias("_at"), F.col(order).cast("long").alias("_id"), *[F.col(k) for k in keys]]
    rows = saved(_under_keys(with_history(messages, history, columns), keys), "keys")
    met = meet(rows, retention_s=retention_s, senders=False, some=history is not None).filter("first_id is not null")
    best = met.groupBy("_id").agg(F.min(F.struct("first_at", "first_id", "_kind")).alias("hit"))
    kind = messages.schema[order].dataType
    return best.select(F.col("_id").cast(kind).alias(order), F.col("hit.first_id").cast(kind).alias("matched_id"), F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("hit._kind") + 1).alias("match_type"))


def senders_by_any_key(messages: DataFrame, history: DataFrame | None = None, *, group: str, keys: list[str], order: str, sender: str, ts: str | None = None, retention_s: int | None = None) -> DataFrame:
    """(order, unique_senders): distinct senders, empty ones left out, of the rows within the retention, at or before each one, that share any key with it.

    A row's senders are sets, one a key; no sender or row is joined with a row.  Rows of ``history`` count, but have no counts themselves."""
    columns = [F.col(group).alias("_g"), moment(ts, order).alias("_at"), F.col(order).cast("long").alias("_id"), F.col(sender).cast("string").alias("_sender"), *[F.col(k) for k in keys]]
    rows = saved(_under_keys(coded(with_history(messages, history, columns)), keys), "keys")
    met = meet(rows, retention_s=retention_s, senders=True, some=history is not None)
    counts = sender_counts(met, "_id").withColumn(order, F.col("_id").cast(messages.schema[order].dataType)).drop("_id")
    return messages.select(order).join(counts, order, "left").fillna(0, ["unique_senders"])


def ranked_rows(messages: DataFrame, *, group: str, order: list[str], name: str = "seq") -> DataFrame:
    """``messages`` with the number of each row within its group, from 1, in two steps: rows are numbered within a day of the group
    (the first of ``order`` must be a time), and the days before are added.  A group's rows never meet in one task."""
    days = messages.withColumn("_day", F.to_date(F.col(order[0]).cast("timestamp")))
    sizes = days.groupBy(group, "_day").agg(F.count("*").alias("_n"))
    before = sizes.select(group, "_day", (F.sum("_n").over(Window.partitionBy(group).orderBy("_day")) - F.col("_n")).alias("_before"))
    own = days.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_day").orderBy(*order)))
    same = own[group].eqNullSafe(before[group]) & own["_day"].eqNullSafe(before["_day"])
    return own.join(before, same).select(*[own[c] for c in messages.columns], (F.col("_before") + F.col("_own")).alias(name))


def longest_runs(messages: DataFrame, *, group: str, value: str, order: list[str]) -> DataFrame:
    """(group, longest_run): the longest run of equal values, by gaps and islands."""
    rows = ranked_rows(messages.select(group, value, *order), group=group, order=order, name="n")
    island = F.col("n") - F.row_number().over(Window.partitionBy(group, value).orderBy("n"))
    return rows.select(group, value, island.alias("island")).groupBy(group, value, "island").agg(F.count("*").alias("run")).groupBy(group).agg(F.max("run").alias("longest_run"))
