"""An index of descriptions for ranked search: postings of one to three characters, in buckets by day.

A posting says that a text, case-folded and without white space, has a run of one, two or three characters; texts shorter than ``SHORT`` have one of
their length, too.  Postings lie as Parquet by day and bucket of the run's hash, and a day is appended without touching others.  A search takes the runs of its query
and reads only their buckets; which texts can match is known before any text is read: keywords need all of their runs, and a text within k edits of the query keeps all but
k times n of its distinct runs of n characters.  Where a query is too short for that, no text can be left out, and the search reads all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions.text import once, with_folded
from echotrace.operators.search import ranked

SIZES, BUCKETS, SHORT = (1, 2, 3), 64, 256
_BLANK = r"(?U)[\s\x1c-\x1f]+"


def _length(n: int) -> str:
    """The run that tells a short text's length; no text has one with this character in this place."""
    return f"\x00{n}"


def postings(rows: DataFrame, *, key: str, text: str, day: str) -> DataFrame:
    """(run, key, day, bucket) of every text; null and empty ones have none but their length."""
    bare = once(with_folded(rows.select(F.col(key).alias("key"), F.col(day).cast("date").alias("day"), F.col(text).alias("text")), "text", "_folded"), bare=F.regexp_replace("_folded", _BLANK, "")).select("key", "day", "bare")
    size = F.length("bare")
    cut = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda k: F.substr(F.col("bare"), k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    short = F.when(size < SHORT, F.array(F.concat(F.lit("\x00"), size.cast("string")))).otherwise(F.array().cast("array<string>"))
    runs = F.array_distinct(F.concat(*[cut(n) for n in SIZES], short))
    return bare.select(F.explode(runs).alias("run"), "key", "day").withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(BUCKETS)).cast("int"))


def append(rows: DataFrame, path: str, *, key: str, text: str, day: str) -> None:
    """Add the postings of new rows; a key must not be added twice."""
    made = postings(rows, key=key, text=text, day=day).repartition("day", "bucket").sortWithinPartitions("day", "bucket", "run")
    made.write.mode("append").partitionBy("day", "bucket").parquet(path)


def _runs(text: str, n: int) -> list[str]:
    return list(dict.fromkeys(text[k : k + n] for k in range(len(text) - n + 1)))


def _needs(query: str, fuzzy_from: float | None) -> list[tuple[list[str], int]] | None:
    """Ways to match: (runs, how many of them a text must have); None where a text may match without any run."""
    words = query.casefold().split()
    if not words:
        return []
    ways = []
    every = list(dict.fromkeys(run for w in words for run in _runs(w, min(len(w), SIZES[-1]))))
    ways.append((every, len(every)))
    if fuzzy_from is not None:
        bare = "".join(words)
        edits = int((1 - fuzzy_from) * len(bare) + 1e-9)
        shares = [(len(_runs(bare, n)) - n * edits, n) for n in SIZES]
        need, n = max((s for s in shares if s[0] > 0), key=lambda s: s[1], default=(0, 0))
        if not need or len(bare) > SHORT:
            return None
        ways += [(_runs(bare, n), need), ([_length(k) for k in range(1, len(bare))], 1)]
    return ways


def candidates(spark: SparkSession, path: str, query: str, *, fuzzy_from: float | None = None, since: str | None = None) -> DataFrame | None:
    """(key) of the texts that the query may find, from the buckets of its runs alone (of the days from ``since`` on); None if that may be any."""
    ways = _needs(query, fuzzy_from)
    if ways is None:
        return None
    stored = spark.read.parquet(path)
    if not ways:
        return stored.select("key").limit(0)
    if since is not None:
        stored = stored.filter(F.col("day") >= F.lit(since).cast("date"))
    runs = list(dict.fromkeys(r for own, _ in ways for r in own))
    hashed = spark.createDataFrame([(r,) for r in runs] or [("",)], "run string").select(F.pmod(F.xxhash64("run"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()  # a row a run of the query
    found = stored.filter(F.col("bucket").isin([r["b"] for r in hashed]) & F.col("run").isin(runs)).groupBy("key").agg(*[F.count_if(F.col("run").isin(own)).alias(f"n{k}") for k, (own, _) in enumerate(ways)])
    enough = F.lit(False)
    for k, (_, need) in enumerate(ways):
        enough = enough | (F.col(f"n{k}") >= need)
    return found.filter(enough).select("key")


def search(rows: DataFrame, path: str, query: str, *, key: str, text: str, recency: str, fuzzy_from: float | None = None, top: int | None = None) -> DataFrame:
    """As operators.search.ranked() without vectors, over the texts that the index leaves."""
    left = candidates(rows.sparkSession, path, query, fuzzy_from=fuzzy_from)
    if left is not None:
        rows = rows.join(left.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left_semi")
    return ranked(rows, query, text=text, order=key, recency=recency, fuzzy_from=fuzzy_from, top=top)
