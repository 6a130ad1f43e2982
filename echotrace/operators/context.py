"""What was said around a message, and how often its content came in a recent window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrace.operators.repeats import SECOND, look_back, ranked_rows


def context_around(messages: DataFrame, marks: DataFrame, *, group: str, order: list[str], mark: str, before: int, after: int) -> DataFrame:
    """(mark, row, offset) of the rows from ``before`` before to ``after`` after each marked row of the same group."""
    rows = ranked_rows(messages.select(group, mark, *[c for c in order if c != mark]), group=group, order=order)
    near = F.explode(F.sequence(F.col("seq") - before, F.col("seq") + after))
    wanted = rows.join(marks.select(mark), mark, "left_semi").select(group, F.col(mark).alias("center"), F.col("seq").alias("center_seq"), near.alias("seq"))
    return wanted.join(rows, [group, "seq"]).select("center", F.col(mark).alias("row_id"), (F.col("seq") - F.col("center_seq")).cast("long").alias("offset"))


def repeat_stats(messages: DataFrame, *, group: list[str], ts: str, sender: str, window_s: int, order: str) -> DataFrame:
    """Over the rows of equal content from ``window_s`` seconds before each message to itself: messages, senders, span in whole seconds."""
    found = look_back(messages, key=group, order=order, ts=ts, sender=sender, window_us=window_s * SECOND + 1)  # closed at both ends
    return found.select(order, F.col("seen").alias("repeats"), "senders", F.floor((F.col("_at") - F.col("first.at")) / SECOND).alias("span_s"))


def last_n(messages: DataFrame, *, group: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each group."""
    back = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= n).drop("_n")
