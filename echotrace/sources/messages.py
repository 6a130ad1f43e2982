"""Messages on disk: Parquet by group and day, and compressed JSON shards of older stores."""

from __future__ import annotations

import gzip
import zlib
from datetime import date, timedelta
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions.names import unquoted

VIDEO = (
    "version: int, name: string, size: bigint, declared_size: bigint, sha256: string, frame_hashes: array<string>, duration_ms: bigint, width: bigint, height: bigint, metadata_hash: string, "
    "analysis: string, source_method: string, source_conflict: boolean, size_mismatch: boolean, size_delta_bytes: bigint, size_ratio: double"
)
MESSAGE = (
    "id string, message_id string, sender_id string, sender_name string, content string, timestamp double, embedding array<double>, has_image boolean, has_video boolean, image_description string, image_hash string, "
    f"videos array<struct<{VIDEO}>>, forward_id string, forward_hash string, forward_text_hash string, forward_text_hash_eligible boolean, forward_content string, forward_node_count bigint, forward_truncated boolean, "
    "forward_partial boolean, forward_hash_version int, url_only boolean, url_hash string, url_host string"
)
_DAY = r"(\d{4}-\d{2}-\d{2})\.json"


def event_date(ts: Column, now: Column | None = None) -> Column:
    """The day of a message by its time, that of ``now`` without one."""
    return F.to_date(F.coalesce(ts, now if now is not None else F.current_timestamp()))


def _shards(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """(path, messages) of the files under ``path`` whose names fit ``names``; messages are null where a file can't be decompressed or isn't JSON.

    A file is read by one task, whole: shards hold a group's day."""

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        def plain(content: bytes) -> str | None:
            try:
                return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode()
            except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                return None

        return contents.map(plain)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = files.option("pathGlobFilter", names) if names else files
    read = files.load(path).select(unquoted(F.col("_metadata.file_path")).alias("path"), text("content").alias("text"))
    # a gzip file by name that doesn't begin as one is no JSON either
    return read.select("path", F.from_json("text", f"array<struct<{MESSAGE}>>").alias("messages"))


def read_shards(spark: SparkSession, path: str, *, today: str | None = None, days: int = 7) -> DataFrame:
    """Day shards ``{group}/{YYYY-MM-DD}.json[.gz]``, each an array of messages; absent fields are null.  Given ``today``, only the shards of that
    day and the ``days`` before are opened.  Shards that can't be read are left out: broken_shards() lists them.

    A shard is read by one task: a store that stays is better written once by write_messages()."""
    names = None
    if today is not None:
        last = date.fromisoformat(today)
        names = "{" + ",".join((last - timedelta(days=n)).isoformat() for n in range(days + 1)) + "}.json*"
    rows = _shards(spark, path, names).filter("messages is not null")
    return rows.select(F.inline("messages"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("group_id"), F.to_date(F.regexp_extract("path", _DAY, 1)).alias("event_date"))


def broken_shards(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the shards that can't be read: cut off, not compressed as they say, or not JSON."""
    return _shards(spark, path).filter("messages is null").select("path")


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Single files ``{group}_messages.json`` of the oldest stores, with group and day, as read_shards() gives them; days are of each message's time."""
    rows = _shards(spark, path).filter("messages is not null").select(F.inline("messages"), F.regexp_extract("path", r"([^/]+)_messages\.json[^/]*$", 1).alias("group_id"))
    return rows.withColumn("event_date", event_date(F.timestamp_seconds("timestamp")))


def in_order(messages: DataFrame) -> DataFrame:
    """With seq: each message's place in its group's history, by time (none: first), then id; numbered in two steps, so that no task sees a whole group."""
    from echotrace.operators.repeats import ranked_rows

    timed = messages.withColumn("ts", F.timestamp_seconds(F.coalesce("timestamp", F.lit(0.0))))
    return ranked_rows(timed, group="group_id", order=["ts", "id"])


def write_messages(messages: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append, or overwrite just the groups and days that ``messages`` has."""
    messages.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("group_id", "event_date").parquet(path)


def retained(messages: DataFrame, *, ts: str, now: str, days: int = 7) -> DataFrame:
    """Messages of the last ``days`` days."""
    return messages.filter(F.col(ts).cast("timestamp") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def retained_days(messages: DataFrame, *, today: str, days: int = 7) -> DataFrame:
    """Messages of the days that a store keeps, today and ``days`` before: a filter on folders."""
    return messages.filter(F.col("event_date").between(F.date_sub(F.lit(today).cast("date"), days), F.lit(today).cast("date")))


def without_group(messages: DataFrame, group: str) -> DataFrame:
    """Everything but one group's messages."""
    return messages.filter(~F.col("group_id").eqNullSafe(group))


def _delete(spark: SparkSession, path: str, column: str, gone) -> int:
    """Delete the folders ``column=value`` right under ``path`` whose value is ``gone``; how many there were."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(at):
        return 0
    found = [s.getPath() for s in files.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(f"{column}=")]
    found = [p for p in found if gone(unquote(p.getName().split("=", 1)[1]))]
    for p in found:
        files.delete(p, True)
    return len(found)


def erase(spark: SparkSession, path: str, group: str) -> bool:
    """Delete a group's messages from a store that write_messages() wrote; whether there were any."""
    return _delete(spark, path, "group_id", lambda value: value == group) > 0


def expire(spark: SparkSession, path: str, *, before: str, column: str = "day") -> int:
    """Delete the folders of days before ``before`` right under ``path``."""
    return _delete(spark, path, column, lambda value: value < before)
