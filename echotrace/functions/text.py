"""Column functions on message texts: white space, times, summaries, filters."""

from __future__ import annotations

import re
import warnings
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: texts that a summary shows
UNKNOWN_SENDER, UNKNOWN_TIME, NO_TEXT = "未知", "时间未知", "（无文字内容）"
AGO = [(60, 1, "秒前"), (3600, 60, "分钟前"), (86400, 3600, "小时前")]
DAYS_AGO = "天前"
PARTS = {"nodes": ("转发", "条"), "partial": "部分内容", "image": "含图片", "video": "含视频"}
# fixed values: the commands that are recorded as messages, what may stand before a command, the search command, and how a content holds a description
OWN_COMMANDS = ["记忆状态", "查看过滤命令", "擦除记忆"]
COMMAND_PREFIX = r"[/!#.。]?"
SEARCH_COMMAND = "搜图"
IMAGE_LABEL = r"(?s)\[图片内容:\s*(.*?)\]\s*$"
SPACE = r"(?U)[\s\x1c-\x1f]"  # white space as Python's patterns have it


@lru_cache
def _folding() -> str:
    """A pattern for the characters that case folding changes other than lower case does, as ranges."""
    odd = [k for k in (*range(0xD800), *range(0xE000, 0x110000)) if chr(k).casefold() != chr(k).lower()]
    starts = [k for n, k in enumerate(odd) if not n or odd[n - 1] != k - 1]
    ends = [k for n, k in enumerate(odd) if n + 1 == len(odd) or odd[n + 1] != k + 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def strip(text: Column) -> Column:
    """Without (Unicode) white space at the ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of (Unicode) white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def _casefold(text: Column) -> Column:
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.casefold())

    return fold(text)


def _folds_oddly(text: Column) -> Column:
    """Whether lower case isn't all that case folding does; ASCII texts are told by their sizes alone."""
    return (F.octet_length(text) > F.char_length(text)) & text.rlike(_folding())


def folded(text: Column) -> Column:
    """Case-folded; only texts with characters that lower case doesn't fold are sent to Python.  For columns that are used once; see with_folded()."""
    odd = _folds_oddly(text)
    return F.when(odd, _casefold(F.when(odd, text))).otherwise(F.lower(text))


def once(rows: DataFrame, **made: Column) -> DataFrame:
    """With new columns, as rows of an inlined array of one: what uses them stays above, instead of repeating what they are made of."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def with_folded(rows: DataFrame, text: str, name: str, holding: list[str] | None = None) -> DataFrame:
    """With ``name``, the case-folded text, made once (null: empty).  Given words ``holding``, texts whose lower case lacks one go first, but for those that fold otherwise."""
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = once(rows, _lower=F.lower(plain), _odd=_folds_oddly(plain))
    if holding is not None:
        rows = rows.filter(F.col("_odd") | reduce(lambda a, w: a & F.col("_lower").contains(w), holding, F.lit(True)))
    rows = rows.withColumn("_special", _casefold(F.when(F.col("_odd"), plain)))
    return once(rows, **{name: F.when(F.col("_odd"), F.col("_special")).otherwise(F.col("_lower"))}).drop("_lower", "_odd", "_special")


def search_form(text: Column) -> Column:
    """Case-folded with single spaces, for search."""
    return squeeze(folded(text))


def epoch(value: Column) -> Column:
    """A number of seconds, or 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def positive_int(value: Column) -> Column:
    """A whole number above 0, or null."""
    number = value.try_cast("bigint")
    return F.when(number > 0, number)


def clock(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd HH:mm:ss")


def ago(seconds: Column) -> Column:
    """How long ago, in whole units."""
    seconds = seconds.cast("bigint")
    out = F.when(F.lit(False), "")
    for limit, unit, name in AGO:
        out = out.when(seconds < limit, F.concat(F.floor(seconds / unit).cast("string"), F.lit(name)))
    return out.otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(DAYS_AGO)))


def shorten(text: Column, length: int = 80) -> Column:
    """White space squeezed; cut with an ellipsis beyond ``length`` characters; a notice where nothing is left."""
    text = squeeze(F.coalesce(text, F.lit("")))
    return F.when(text == "", NO_TEXT).when(F.length(text) > length, F.concat(F.rtrim(F.substr(text, F.lit(1), F.lit(length))), F.lit("…"))).otherwise(text)


def summary(sender: Column, ts: Column, now: Column, content: Column, *, forward: Column | None = None, nodes: Column | None = None, partial: Column | None = None, image: Column | None = None, video: Column | None = None) -> Column:
    """``sender · time（ago）`` and what the message holds, over the shortened content.  ``partial``: a forwarded bundle of which something is missing."""
    age = F.unix_timestamp(now) - F.unix_timestamp(ts)
    when = F.when(ts.isNull() | (F.unix_timestamp(ts) <= 0), UNKNOWN_TIME).otherwise(F.concat(clock(ts), F.lit("（"), ago(age), F.lit("）")))
    has = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    forward = has(forward)
    count = F.when(forward & (nodes > 0), F.concat(F.lit(PARTS["nodes"][0]), nodes.cast("string"), F.lit(PARTS["nodes"][1]))) if nodes is not None else F.lit(None).cast("string")
    tags = [count, F.when(forward & has(partial), PARTS["partial"]), F.when(has(image), PARTS["image"]), F.when(has(video), PARTS["video"])]
    head = F.concat_ws(" · ", F.coalesce(F.nullif(sender, F.lit("")), F.lit(UNKNOWN_SENDER)), when, *tags)
    return F.concat(head, F.lit("\n"), shorten(content))


def _alternation(commands: list[str]) -> str:
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", c) for c in sorted(set(commands)))


def command_pattern(commands: list[str]) -> str:
    """One pattern for messages that are a command, with or without arguments."""
    return rf"(?iudU)\A{COMMAND_PREFIX}(?:{_alternation(commands)})(?:$|[\s\x1c-\x1f].*$)"


def is_command(text: Column, commands: list[str]) -> Column:
    """Whether a message is a command of another program; the library's own commands are messages like any other."""
    others = [c for c in commands if c not in OWN_COMMANDS]
    text = strip(F.coalesce(text, F.lit("")))
    return ~text.rlike(command_pattern(OWN_COMMANDS)) & text.rlike(command_pattern(others)) if others else F.lit(False)


def search_query(text: Column) -> Column:
    """What a search command asks for: all that follows it; null for other messages."""
    pattern = rf"(?sU)\A/?{SEARCH_COMMAND}(?:[\s\x1c-\x1f]+|$)(.*)\z"
    text = strip(F.coalesce(text, F.lit("")))
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def usable_patterns(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Patterns in Java's spelling (named groups differ from Python's); those that Python or Java can't compile are left out, with a warning."""
    out = []
    for p in patterns:
        java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p.replace("(?P<", "(?<"))
        try:
            re.compile(p)
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:  # noqa: BLE001 - a pattern of the user's
            warnings.warn(f"pattern {p!r} is left out: {e}", stacklevel=2)
            continue
        out.append(java)
    return out


def fully_matches(text: Column, patterns: list[str]) -> Column:
    """Whether the whole text matches one of the patterns; patterns that can't be compiled are left out."""
    out = F.lit(False)
    for p in usable_patterns(SparkSession.active(), patterns):
        out = out | text.rlike(rf"\A(?:{p})\z")
    return out


def image_description(stored: Column, content: Column) -> Column:
    """The stored description, else the one that the content carries."""
    return F.coalesce(F.nullif(F.trim(stored), F.lit("")), F.nullif(F.trim(F.regexp_extract(content, IMAGE_LABEL, 1)), F.lit("")))
