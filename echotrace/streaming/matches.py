"""Any matcher on a stream: each micro-batch is matched with itself and with what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from echotrace.operators.repeats import DAY

Matcher = Callable[[DataFrame, DataFrame], DataFrame]


def stream_matches(stream: DataFrame, matcher: Matcher, store: str, out: str, checkpoint: str, *, ts: str, retention_s: int = 7 * DAY, fields: list[str] | None = None) -> StreamingQuery:
    """``matcher(batch, history)`` of each micro-batch, written under ``out`` by batch; matchers are those of operators.repeats, forwards, similar and video, which
    never compare two stored rows.

    Messages are stored in folders by day and batch (all columns, or ``fields``: what the matcher reads); a batch reads the days that its messages look back on.
    A batch that runs again overwrites its own folders and sees only batches before it, so results stay the same.  Old days go by
    sources.messages.expire()."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.select(*fields) if fields else batch
        day = F.to_date(F.col(ts).cast("timestamp"))
        kept.withColumns({"day": day, "batch": F.lit(number)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(store)
        stored = spark.read.option("basePath", store).schema(T.StructType([*kept.schema.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.IntegerType())])).parquet(store)
        now = stored.filter(F.col("batch") == number)
        days = now.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
        if days["first"] is None:
            return
        reach = F.col("day").between(F.date_sub(F.lit(days["first"]), retention_s // DAY + 1), F.lit(days["last"]))
        history = stored.filter((F.col("batch") < number) & reach)
        matcher(now.drop("day", "batch"), history.drop("day", "batch")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
