"""Answers of providers that are kept by content, so that a content is asked once, however often and in whichever run it comes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.providers import ask_column


class Cache:
    """Answers of one provider under ``path``: Parquet (key: sha256 of the content, content, answer), a folder a run, which appears as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str, kind: str):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def known(self) -> DataFrame:
        """(key, content, answer); a content that two runs asked at the same time has one of their answers."""
        schema = f"key string, content string, answer {self.kind}"
        try:
            stored = self.spark.read.schema(schema).parquet(f"{self.path}/run=*")
        except AnalysisException:  # nothing was stored yet
            return self.spark.createDataFrame([], schema)
        return stored.groupBy("key", "content").agg(F.min_by("answer", F.xxhash64(F.to_json(F.struct("answer")))).alias("answer"))

    def _add(self, answers: DataFrame) -> None:
        """Write under a name that readers don't see, then give the folder its name."""
        name = uuid.uuid4().hex
        answers.write.parquet(f"{self.path}/_open-{name}")
        context = self.spark.sparkContext
        place = lambda n: context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
        files = place(f"run={name}").getFileSystem(context._jsc.hadoopConfiguration())
        if not files.rename(place(f"_open-{name}"), place(f"run={name}")):
            raise OSError(f"{self.path}/_open-{name} could not be renamed")

    def ask(self, rows: DataFrame, column: str, into: str, provider: Callable[[list], list], *, batch: int = 64) -> DataFrame:
        """``rows`` with the answer to ``column``: stored ones by a join, others asked once for each distinct content of the whole table and then stored.  Where the
        provider fails there is no answer, and nothing is stored: a later run asks again."""
        known = self.known()
        key = F.sha2(F.col(column), 256)
        asked = rows.filter(F.col(column).isNotNull()).select(key.alias("key"), F.col(column).alias("content")).distinct()
        new = ask_column(asked.join(known.select("key", "content"), ["key", "content"], "left_anti"), "content", "answer", self.kind, provider, batch=batch).filter("answer is not null")
        self._add(new)
        found = self.known().select(F.col("key").alias("_key"), F.col("content").alias("_content"), F.col("answer").alias(into))
        return rows.drop(into).join(found, (key == F.col("_key")) & (F.col(column) == F.col("_content")), "left").drop("_key", "_content")
