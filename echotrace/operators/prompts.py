"""Prompts for the judge: what was said around a repeat, within budgets of rows and characters, and the counts, gathered in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrace.functions.text import clock, shorten
from echotrace.operators.judging import judge_contexts, judge_statistics, statistics_text
from echotrace.providers import DEFAULT_JUDGE_PROMPT

PARTS = ("recent", "history")


def context_lines(messages: DataFrame, contexts: DataFrame, *, order: str, ts: str, sender: str, content: str, line_chars: int = 80, most_chars: int = 2000) -> DataFrame:
    """(mark, recent, history, left_out) from judge_contexts(): lines ``time sender: text`` of each part in order.

    A part has ``most_chars`` characters: the lines nearest to the marked message keep theirs, older ones beyond go.  Lengths are summed before any text is gathered."""
    said = messages.select(F.col(order).alias("row_id"), F.concat(clock(F.col(ts).cast("timestamp")), F.lit(" "), F.coalesce(F.nullif(F.col(sender).cast("string"), F.lit("")), F.lit("?")), F.lit(": "), shorten(F.col(content), line_chars)).alias("line"))
    rows = contexts.join(said, "row_id")
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("mark", "part").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_kept", upto <= most_chars)
    gather = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_kept") & (F.col("part") == part), F.struct("place", "line")))), lambda x: x["line"]), "\n")
    return kept.groupBy("mark").agg(*[gather(p).alias(p) for p in PARTS], F.count_if(~F.col("_kept")).alias("left_out"))


def judge_prompts(messages: DataFrame, marks: DataFrame, *, group: str, order: str, ts: str, sender: str, content: str, window_s: int = 600, most: int = 12, line_chars: int = 80, most_chars: int = 2000, template: str = DEFAULT_JUDGE_PROMPT) -> DataFrame:
    """(order, content, matched, history, recent, stats, prompt) of the marks (order, matched_id).  ``template`` has these names in braces, and doubled braces for
    braces that stay; texts go in as they are."""
    contexts = judge_contexts(messages, marks, group=group, order=order, ts=ts, window_s=window_s, most=most)
    lines = context_lines(messages, contexts, order=order, ts=ts, sender=sender, content=content, line_chars=line_chars, most_chars=most_chars)
    stats = judge_statistics(messages, group=group, order=order, ts=ts, sender=sender, content=content, window_s=window_s)
    counts = stats.select(order, statistics_text(window_s, stats).alias("stats"))
    text = messages.select(F.col(order).alias("_id"), shorten(F.col(content), line_chars).alias("_text"))
    rows = marks.select(order, "matched_id").join(text.withColumnsRenamed({"_id": order, "_text": "content"}), order).join(text.withColumnsRenamed({"_id": "matched_id", "_text": "matched"}), "matched_id", "left")
    rows = rows.join(counts, order, "left").join(lines.withColumnRenamed("mark", order), order, "left")
    names = ("content", "matched", "history", "recent", "stats")
    rows = rows.select(order, *[F.coalesce(n, F.lit("")).alias(n) for n in names])
    return rows.withColumn("prompt", _filled(template, names))


def _filled(template: str, names: tuple[str, ...]):
    """The template as a column: its literal pieces and the named columns, in order."""
    from string import Formatter

    pieces = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            if name not in names or spec or conversion:
                raise ValueError(f"a prompt has no {name!r}")
            pieces.append(F.col(name))
    return F.concat(*pieces)
