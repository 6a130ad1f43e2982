"""Seams for models and platforms: callables that the user brings, called in batches inside tasks, after all that makes calls needless."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: how answers of vision models tell a sticker
STICKER_WORDS = ('is_sticker": true', "表情包", "emoji", "sticker", "熊猫头", "滑稽")
TRUE_WORDS = ("true", "yes", "1", "t")

Embed = Callable[[list[str]], list[list[float] | None]]
Ask = Callable[[list[str]], list[str | None]]

DEFAULT_JUDGE_PROMPT = """A message in a group chat repeats an earlier one. Decide whether to point that out.
Point it out if a topic, piece of news or picture comes up again unawares. Don't if people echo each other on purpose, greet, joke or vote.
Message: {content}
Earlier message: {matched}
Said around the earlier one:
{history}
Said just now:
{recent}
Counts:
{stats}
Answer with JSON alone: {{"should_remind": true or false, "reason": "..."}}"""


def _called(provider: Callable[[list], list], asked: list) -> list:
    """The provider's answers; what fails as a batch is asked one by one, and what fails alone has none."""
    try:
        out = list(provider(asked))
        if len(out) == len(asked):
            return out
    except Exception:  # noqa: BLE001 - whatever a provider raises
        pass
    if len(asked) == 1:
        return [None]
    return [x for one in asked for x in _called(provider, [one])]


def ask_column(rows: DataFrame, column: str, into: str, kind: str, provider: Callable[[list], list], *, batch: int = 64) -> DataFrame:
    """``rows`` with the provider's answer to ``column``, null where that is null or the call failed; equal values of an Arrow batch are asked once."""
    names = [*rows.columns, into]

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = list(dict.fromkeys(frame[column].dropna()))
            answers = {}
            for k in range(0, len(asked), batch):
                answers.update(zip(asked[k : k + batch], _called(provider, asked[k : k + batch]), strict=True))
            out = frame.copy()
            out[into] = pd.Series([None if x is None or x != x else answers.get(x) for x in frame[column]], index=frame.index, dtype=object)
            yield out[names]

    return rows.mapInPandas(call, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"`{into}` {kind}").fields]))


def embed(rows: DataFrame, content: str, provider: Embed | None, *, into: str = "embedding") -> DataFrame:
    """With embeddings of what is to be embedded; without a provider there are none."""
    if provider is None:
        return rows.withColumn(into, F.lit(None).cast("array<double>"))
    to_lists = lambda texts: [None if v is None else [float(x) for x in v] for v in provider(texts)]
    return ask_column(rows, content, into, "array<double>", to_lists)


def _fenced(text: str) -> str:
    """What stands in a fence marked json, else in the first fence, else all."""
    for pattern in (r"(?s)```json(.*?)(?:```|\Z)", r"(?s)```(.*?)(?:```|\Z)"):
        if found := re.search(pattern, text):
            return found.group(1).strip()
    return text.strip()


def vision_answer(text: str | None) -> str | None:
    """The description that a vision model gives; None for stickers and failures."""
    if not text or not text.strip():
        return None
    try:
        given = json.loads(_fenced(text.strip()))
        sticker = given.get("is_sticker", False)
        sticker = sticker.lower() in TRUE_WORDS if isinstance(sticker, str) else bool(sticker)
        return None if sticker or str(given.get("type", "")).lower() == "emoji" else given.get("content", "")
    except json.JSONDecodeError:
        return None if any(w in text.lower() for w in STICKER_WORDS) else text.strip()
    except AttributeError:
        return None


def judge_answer(text: str | None) -> Any:
    """Whether a judge says that a repeat is worth flagging; no answer is no."""
    if not text:
        return False
    try:
        return json.loads(_fenced(text)).get("should_remind", False)
    except (ValueError, AttributeError):
        return '"should_remind": true' in text.lower()


def describe_images(messages: DataFrame, sources: str, provider: Ask | None, *, into: str = "described") -> DataFrame:
    """With map<source, description> of a message's images (array<string>).  Each distinct source is asked once; stickers have no description."""
    if provider is None:
        return messages.withColumn(into, F.create_map().cast("map<string,string>"))
    asked = ask_column(messages.select(F.explode(sources).alias("source")).distinct(), "source", "description", "string", lambda xs: [vision_answer(t) for t in provider(xs)])
    found = asked.filter("description is not null")
    rows = messages.withColumn("_row", F.monotonically_increasing_id())
    own = rows.select("_row", F.explode(sources).alias("source")).distinct().join(found, "source").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("source", "description"))).alias(into))
    return rows.join(own, "_row", "left").drop("_row").withColumn(into, F.coalesce(into, F.create_map().cast("map<string,string>")))


def judge_prompt(values: dict[str, str], template: str = "") -> str:
    """The prompt; a template of the user's that doesn't fit the values gives way to the default."""
    try:
        return (template or DEFAULT_JUDGE_PROMPT).format(**values)
    except (KeyError, IndexError, ValueError):
        return DEFAULT_JUDGE_PROMPT.format(**values)


def judge(verdicts: DataFrame, prompts: DataFrame, provider: Ask | None, *, order: str, on: bool = True) -> DataFrame:
    """Verdicts with those of ``remind`` put to the judge (prompts: order, prompt): judged_no where it doesn't agree.  Other rows cost no call."""
    if not on:
        return verdicts
    survivors = verdicts.filter("verdict = 'remind'").join(prompts.select(order, "prompt"), order, "left")
    if provider is None:
        answered = survivors.withColumn("_yes", F.lit(False))
    else:
        answered = ask_column(survivors, "prompt", "_yes", "boolean", lambda xs: [bool(judge_answer(t)) for t in provider(xs)])
    judged = answered.withColumn("verdict", F.when(F.coalesce("_yes", F.lit(False)), "remind").otherwise("judged_no")).select(*verdicts.columns)
    return verdicts.filter("verdict is null or verdict <> 'remind'").unionByName(judged)


def with_files(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Videos (source, file_reference, source_method) with what a table of files says (reference, path, url, size, readable): a readable file of
    the reference goes before its address; videos whose own source is readable keep it."""
    found = files.select(F.col("reference").alias("_ref"), F.col("path").alias("_path"), F.col("url").alias("_url"), F.col("size").alias("_size"), F.col("readable").alias("_readable")).dropDuplicates(["_ref"])
    rows = videos.join(found, (F.col("file_reference") == F.col("_ref")) & (F.col("source_method") != "component_path"), "left")
    here = F.coalesce(F.col("_readable") & (F.col("_path") != ""), F.lit(False))
    source = F.when(here, F.col("_path")).when(F.col("_url") != "", F.col("_url")).otherwise(F.col("source"))
    method = F.when(here, "get_file_local").when(F.col("_url") != "", "get_file_http").otherwise(F.col("source_method"))
    return rows.withColumns({"source": source, "source_method": method, "actual_size": F.col("_size")}).drop("_ref", "_path", "_url", "_size", "_readable")


def can_reply(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages with can_reply: the platform still knows them (answers: message_id, status, retcode)."""
    good = ~F.coalesce(F.lower("status").isin("failed", "error"), F.lit(False)) & F.coalesce(F.col("retcode").cast("string").isin("", "0"), F.lit(True)) & F.col("message_id").isNotNull()
    known = answers.filter(good).select("message_id").distinct().withColumn("can_reply", F.lit(True))
    return messages.join(known, "message_id", "left").fillna(False, ["can_reply"])
