"""Which messages are kept at all, in order: a group, not blocked, not the bot's own, some content, long enough, not ignored, no command."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions.text import fully_matches, is_command

#: lists of up to so many entries stand in the condition itself
INLINE = 1000


def has_group(group: Column) -> Column:
    return F.coalesce(group.cast("string"), F.lit("")) != ""


def not_blocked(group: Column, blocked: list[str]) -> Column:
    return ~group.cast("string").isin([str(b) for b in blocked]) if blocked else F.lit(True)


def without_blocked(messages: DataFrame, group: str, blocked: list[str]) -> DataFrame:
    """Messages of other groups; a long list goes through an anti join, which Spark broadcasts only if it is small."""
    if len(blocked) <= INLINE:
        return messages.filter(F.coalesce(not_blocked(F.col(group), blocked), F.lit(True)))
    listed = messages.sparkSession.createDataFrame([(str(b),) for b in dict.fromkeys(blocked)], "_blocked string")
    return messages.join(listed, F.col(group).cast("string") == F.col("_blocked"), "left_anti")


def not_own(sender: Column, own: Column) -> Column:
    """Not the bot's own; without an own id nothing is."""
    own = F.coalesce(own.cast("string"), F.lit(""))
    return (own == "") | ~F.coalesce(sender.cast("string") == own, F.lit(False))


def long_enough(content: Column, least: int, *others: Column) -> Column:
    """At least so many characters; messages with one of ``others`` (image, bundle, videos) are exempt."""
    exempt = F.lit(False)
    for other in others:
        exempt = exempt | F.coalesce(other, F.lit(False))
    return exempt | (F.length(content) >= least)


def kept(routed: DataFrame, config: SimpleNamespace, *, commands: list[str] | None = None, own_id: str = "") -> DataFrame:
    """Of routed messages, those to be recorded."""
    rows = without_blocked(routed.filter(has_group(F.col("group_id"))), "group_id", config.blocked_groups)
    rows = rows.filter(not_own(F.col("sender_id"), F.lit(own_id))).filter(F.col("content").isNotNull())
    rows = rows.filter(long_enough(F.col("content"), config.min_text_length, F.col("image_source").isNotNull(), F.col("forward_id").isNotNull(), F.col("modality") == "video"))
    if config.ignore_regex:
        rows = rows.filter(~fully_matches(F.col("content"), config.ignore_regex))
    if config.auto_filter_commands and commands:
        rows = rows.filter(~is_command(F.col("content"), commands))
    return rows


def plugin_commands(plugins: DataFrame) -> DataFrame:
    """(command) of active plugins (active boolean, command string, aliases array<string>, command_group string), each once, in order."""
    every = F.concat(F.array("command", "command_group"), F.coalesce("aliases", F.array().cast("array<string>")))
    return plugins.filter("active").select(F.explode(every).alias("command")).filter("command <> ''").distinct().orderBy("command")


def command_lines(spark: SparkSession, commands: DataFrame, width: int = 5) -> DataFrame:
    """(line, text): the commands, ``width`` to a line.  A registry has as many rows as there are commands to type."""
    names = [r[0] for r in commands.orderBy("command").collect()]
    return spark.createDataFrame([(k // width, "  ".join(names[k : k + width])) for k in range(0, len(names), width)], "line int, text string")
