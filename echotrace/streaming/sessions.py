"""Sessions of repeats by event time: runs of a content's messages with no gap of a given length between them.  An extra: nothing else here needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def repeat_sessions(messages: DataFrame, *, key: list[str], ts: str, sender: str, gap_s: int, late_s: int | None = None) -> DataFrame:
    """(key, started, ended, times, senders): each session's first and last possible moment in microseconds (its last message and the gap), its messages and distinct senders.

    For a stream, ``late_s`` is how far messages may be behind the newest one; a session comes out once the watermark has passed its end, and later messages
    are left out: left_out() counts them.  Rows without a time belong to no session."""
    rows = messages.withColumn("_time", F.col(ts).cast("timestamp")).filter("_time is not null")
    if late_s is not None:
        rows = rows.withWatermark("_time", f"{late_s} seconds")
    found = rows.groupBy(*key, F.session_window("_time", f"{gap_s} seconds").alias("_session")).agg(F.count("*").alias("times"), F.size(F.collect_set(sender)).cast("bigint").alias("senders"))
    return found.select(*key, F.unix_micros("_session.start").alias("started"), F.unix_micros("_session.end").alias("ended"), "times", "senders")


def start(sessions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return sessions.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def left_out(query: StreamingQuery) -> int:
    """How often the watermark has left messages out, over the progress that Spark still holds; late messages of one session that come together count once."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
