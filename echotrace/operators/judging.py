"""What a judge is told of a repeat: what was said lately and around the first time, and counts over the whole recent window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions.text import clock, squeeze
from echotrace.operators.repeats import SECOND, look_back, ranked_rows

#: fixed values: the lines of the counts as text
LINES = ("- 统计窗口：最近%d秒", "- 窗口内消息：%d条", "- 待判断文本精确出现：%d次，涉及%d名发送者", "- 精确复读时间范围：%s", "- 首次至本次跨度：%d秒", "- 最长连续相同消息：%d条")
BETWEEN, NO_RANGE = " 至 ", "无"


def _longest_runs(rows: DataFrame) -> DataFrame:
    """(order, run) of rows (_g, _text, n, w, order): the longest run of the row's text in rows w to n of its group.

    Rows of a text go by in order; finished runs wait in a queue of falling lengths, so that the longest in the window is its first, or its
    second where the window cuts the first."""
    kind = rows.schema["_id"].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done, start, last = None, deque(), 0, 0
        for batch in batches:
            out = []
            for key, n, w in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != at:
                    at, start = key, n
                    done.clear()
                elif n != last + 1:
                    while done and done[-1][1] - done[-1][0] <= last - start:
                        done.pop()
                    done.append((start, last))
                    start = n
                last = n
                while done and done[0][1] < w:
                    done.popleft()
                lengths = [e - max(s, w) + 1 for s, e in list(done)[:1]] + [done[1][1] - done[1][0] + 1 if len(done) > 1 else 0]
                out.append(max(n - max(start, w) + 1, *lengths))
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(out, pa.int64())], names=["_id", "run"])

    dealt = rows.select(F.xxhash64("_g").alias("g"), F.xxhash64("_text").alias("t"), "n", "w", "_id").repartition("g", "t").sortWithinPartitions("g", "t", "n")
    return dealt.mapInArrow(sweep, f"_id {kind}, run long")


def judge_statistics(messages: DataFrame, *, group: str, order: str, ts: str, sender: str, content: str, window_s: int = 600) -> DataFrame:
    """(order, messages_in_window, exact_repeat_count, exact_unique_senders, exact_first, exact_last, exact_span_seconds, longest_consecutive_exact)
    of every message, over those of its group from ``window_s`` seconds before it to itself.  Texts are compared with white space squeezed;
    an empty one has no repeats."""
    rows = messages.select(F.col(group).alias("_g"), F.col(order).alias("_id"), F.col(ts).cast("timestamp").alias("_ts"), F.nullif(F.col(sender).cast("string"), F.lit("")).alias("_sender"), squeeze(F.coalesce(F.col(content), F.lit(""))).alias("_text"))
    look = dict(order="_id", ts="_ts", sender="_sender", window_us=window_s * SECOND + 1)
    all_ = look_back(rows, key=["_g"], **look).select("_id", F.col("seen").alias("messages_in_window"))
    exact = look_back(rows.filter("_text <> ''"), key=["_g", "_text"], **look)
    when = lambda us: F.timestamp_micros(us)
    exact = exact.select("_id", F.col("seen").alias("exact_repeat_count"), F.col("senders").alias("exact_unique_senders"), when(F.col("first.at")).alias("exact_first"), when(F.col("_at")).alias("exact_last"), F.floor((F.col("_at") - F.col("first.at")) / SECOND).alias("exact_span_seconds"))
    numbered = ranked_rows(rows.select("_g", "_id", "_ts", "_text"), group="_g", order=["_ts", "_id"], name="n").join(all_, "_id")
    runs = _longest_runs(numbered.filter("_text <> ''").withColumn("w", F.col("n") - F.col("messages_in_window") + 1))
    zero = ["exact_repeat_count", "exact_unique_senders", "exact_span_seconds", "longest_consecutive_exact"]
    out = all_.join(exact, "_id", "left").join(runs.withColumnRenamed("run", "longest_consecutive_exact"), "_id", "left").fillna(0, zero)
    return out.withColumnRenamed("_id", order)


def judge_contexts(messages: DataFrame, marks: DataFrame, *, group: str, order: str, ts: str, window_s: int = 600, most: int = 12) -> DataFrame:
    """(mark, part, row_id, place) for marks (order, matched_id): the last ``most`` rows of the window before the marked one (part recent), and,
    where the match lies before the window, ``most`` rows around it (part history)."""
    rows = messages.select(F.col(group).alias("_g"), F.col(order).alias("_id"), F.col(ts).cast("timestamp").alias("_ts"))
    seen = look_back(rows.withColumn("_none", F.lit(None).cast("string")), key=["_g"], order="_id", ts="_ts", sender="_none", window_us=window_s * SECOND + 1).select("_id", "seen")
    numbered = ranked_rows(rows, group="_g", order=["_ts", "_id"], name="n")
    own = marks.select(F.col(order).alias("_id"), "matched_id").join(numbered, "_id").join(seen, "_id").select("_g", F.col("_id").alias("mark"), "matched_id", F.col("n").alias("at"), (F.col("n") - F.col("seen") + 1).alias("w"))
    first = numbered.select(F.col("_id").alias("matched_id"), F.col("n").alias("m"))
    own = own.join(first, "matched_id", "left")
    before = most // 2
    recent = F.when(F.col("w") < F.col("at"), F.sequence(F.greatest("w", F.col("at") - most), F.col("at") - 1))
    old = F.when(F.col("m") < F.col("w"), F.sequence(F.greatest(F.col("m") - before, F.lit(1)), F.least(F.col("m") + (most - before - 1), F.col("at") - 1)))
    places = own.select("_g", "mark", F.lit("recent").alias("part"), F.explode(recent).alias("n")).unionByName(own.select("_g", "mark", F.lit("history").alias("part"), F.explode(old).alias("n")))
    return places.join(numbered, ["_g", "n"]).select("mark", "part", F.col("_id").alias("row_id"), F.col("n").alias("place"))


def statistics_text(window_s: int, stats: DataFrame) -> Column:
    """The counts as lines for a prompt."""
    span = F.when(stats["exact_first"].isNotNull() & stats["exact_last"].isNotNull(), F.concat(clock(stats["exact_first"]), F.lit(BETWEEN), clock(stats["exact_last"]))).otherwise(NO_RANGE)
    values = [[F.lit(window_s)], [stats["messages_in_window"]], [stats["exact_repeat_count"], stats["exact_unique_senders"]], [span], [stats["exact_span_seconds"]], [stats["longest_consecutive_exact"]]]
    return F.concat_ws("\n", *[F.format_string(line, *own) for line, own in zip(LINES, values, strict=True)])
