"""Verdicts on a stream from keyed state: what a content's window holds lies in Spark's state store, not in folders of history.

A key (group, content) holds the messages of its window as a queue (number -> time, id, sender), one row for each of its senders with the time of their last message, and
where the queue begins and ends.  A message drops what has left the window from the queue's head, a sender with their last message, and then sees the head and the count of
senders: constant work for a message, whatever the key holds.  A timer drops all of a key once the watermark has passed its last message by the retention.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from echotrace.operators.repeats import DAY
from echotrace.operators.sliding import SECOND

OUT = "id long, matched_id long, unique_senders long, verdict string"


class WindowOfKey(StatefulProcessor):
    def __init__(self, retention_s: int, min_senders: int, cooldown_s: int):
        self.window, self.min_senders, self.cooldown = retention_s * SECOND, min_senders, cooldown_s * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "n long", "at long, id long, sender string")
        self.senders = handle.getMapState("senders", "sender string", "last long")
        self.ends = handle.getValueState("ends", "head long, tail long, senders long, timer long")

    def _leave(self, head: int, tail: int, count: int, before: int) -> tuple[int, int]:
        """Drop what happened at ``before`` or earlier."""
        while head < tail:
            at, _, sender = self.queue.getValue((head,))
            if at > before:
                break
            if sender is not None and self.senders.getValue((sender,))[0] == at:
                self.senders.removeKey((sender,))
                count -= 1
            self.queue.removeKey((head,))
            head += 1
        return head, count

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        head, tail, count, timer = self.ends.get() if self.ends.exists() else (0, 0, 0, None)
        out = []
        for at, id_, sender in self._in_order(rows):
            head, count = self._leave(head, tail, count, at - self.window)
            first = self.queue.getValue((head,)) if head < tail else None
            if sender is not None:
                count += not self.senders.containsKey((sender,))
                self.senders.updateValue((sender,), (at,))
            self.queue.updateValue((tail,), (at, id_, sender))
            tail += 1
            if first is None:
                verdict = "no_match"
            elif sender is not None and first[2] == sender:
                verdict = "same_sender"
            else:
                verdict = "few_senders" if count < self.min_senders else "cooldown" if at < first[0] + self.cooldown else "remind"
            out.append((id_, first[1] if first else None, count, verdict))
            due = (at + self.window) // 1000 + 1
            if timer is None or due > timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
        self.ends.update((head, tail, count, timer))
        yield pd.DataFrame(out, columns=["id", "matched_id", "unique_senders", "verdict"]).astype({"matched_id": "Int64"})

    @staticmethod
    def _in_order(rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """The batch's messages by time, then id."""
        frames = [f for f in rows if len(f)]
        if not frames:
            return []
        whole = pd.concat(frames).iloc[:, -4:-1].set_axis(["at", "id", "sender"], axis=1).sort_values(["at", "id"])  # Spark names columns by their places
        return [(int(at), int(id_), sender if isinstance(sender, str) else None) for at, id_, sender in zip(*(whole[c] for c in whole.columns), strict=True)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.queue.clear()
        self.senders.clear()
        self.ends.clear()
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "matched_id": pd.Series(dtype="Int64"), "unique_senders": pd.Series(dtype="int64"), "verdict": pd.Series(dtype="str")})


def keyed_verdicts(stream: DataFrame, *, key: list[str], order: str, ts: str, sender: str, retention_s: int = 7 * DAY, min_senders: int = 3, cooldown_s: int = 3600, late_s: int = 0) -> DataFrame:
    """(id, matched_id, unique_senders, verdict) as repeats.repeat_verdicts() has them, for messages that come in order of time from batch to batch.

    A message up to ``late_s`` behind the newest one is judged by what its key holds then; later ones are dropped by the watermark.  A null in the key is
    not matched with anything and keeps no state: such messages are left out here."""
    timed = stream.withColumn("_time", F.col(ts).cast("timestamp")).withWatermark("_time", f"{late_s} seconds").dropna(subset=key)
    keys = [F.col(k).cast("string").alias(f"_k{n}") for n, k in enumerate(key)]
    rows = timed.select(*keys, F.unix_micros("_time").alias("_at"), F.col(order).cast("long").alias("_id"), F.col(sender).cast("string").alias("_sender"), "_time")
    return rows.groupBy(*[f"_k{n}" for n in range(len(key))]).transformWithStateInPandas(WindowOfKey(retention_s, min_senders, cooldown_s), OUT, "Append", "EventTime")


def start(verdicts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the verdicts; state is in the checkpoint, by RocksDB, so that a restarted query goes on where the last one ended."""
    verdicts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return verdicts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
