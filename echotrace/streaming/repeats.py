"""Verdicts on a stream: each micro-batch is compared with itself and the history written so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from echotrace.operators.repeats import DAY, repeat_verdicts


def stream_verdicts(stream: DataFrame, history_path: str, out_path: str, checkpoint: str, *, ts: str, retention_s: int = 7 * DAY, **options) -> StreamingQuery:
    """Messages see all earlier ones of the retention, those of their own batch included.  History lies in folders by day and batch: a batch
    reads the days that its messages look back on, and batches before it; one that runs again overwrites its own folders, so results
    stay the same.  Old days can be dropped by sources.messages.expire()."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        day = F.to_date(F.col(ts).cast("timestamp"))
        batch.withColumns({"day": day, "batch": F.lit(number)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(history_path)
        stored = spark.read.option("basePath", history_path).schema(T.StructType([*batch.schema.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.IntegerType())])).parquet(history_path)
        now = stored.filter(F.col("batch") == number)
        first = now.agg(F.min("day").alias("d")).first()["d"]
        if first is None:
            return
        days = retention_s // DAY + 1
        history = stored.filter((F.col("batch") < number) & (F.col("day") >= F.date_sub(F.lit(first), days)))
        repeat_verdicts(now.drop("day", "batch"), history.drop("day", "batch"), ts=ts, retention_s=retention_s, **options).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
