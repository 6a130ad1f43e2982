"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order drawn by a hash, make up one long run of words that is cut into blocks of ``block_words``.
Slot j of the mix belongs to the source whose stretch of the cumulative target weights holds the j-th golden-ratio point
``frac((j + 1/2) / phi)``; the slots of a source are ranked, and rank r takes block ``r mod blocks`` of it.  Every stretch of the
schedule holds the sources close to their weights; what the points give a source more or less than its target is left out or added at
the end, so that it takes its target to within half a block (the last block of a round has what is left of the source), and one block at least.

Targets: ``ratio`` times all words, shared by weight; a source stops at ``limit`` times its size and its excess is shared again.
Ranks past ``limit`` rounds are left out, so no document is taken more than ``limit`` times.

All counting is by two-level sums (slots by chunk, documents by hash bucket): no task sees all of a large source.  What the driver
holds is one row a source; more than ``MAX_SOURCES`` raise an error.  Null texts have no words and are never taken; a null
source is a source of its own, last in order; repeated rows are separate documents; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, getcontext
from itertools import cycle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.llm.common import pieces, read_table, save, word_spans

WEIGHTS = (3, 1, 2)
RATIO, LIMIT, BLOCK_WORDS = 1.5, 2, 64
CHUNK = 1 << 16
MAX_PARTS = 4096
MAX_SOURCES = 100_000
BUCKET_DOCS = 4096
getcontext().prec = 60
_GOLDEN = (Decimal(5).sqrt() - 1) / 2


def targets(sizes: list[int], weights: list[float], ratio: float = RATIO, limit: float = LIMIT) -> list[float]:
    """Words to take from each source: ``ratio`` times all, by weight, none above ``limit`` times its size."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = ratio * sum(sizes)
    while open_:
        share = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if share * weights[k] > limit * sizes[k]}
        if not full:
            for k in open_:
                out[k] = share * weights[k]
            break
        for k in full:
            out[k] = float(limit * sizes[k])
            left -= out[k]
        open_ -= full
    return out


def golden(j: np.ndarray) -> np.ndarray:
    """``frac((j + 1/2) / phi)``; j is taken apart so that places up to 2^52 keep their precision."""
    high = float((_GOLDEN * (1 << 26)) % 1)
    return ((j >> 26).astype(float) * high % 1 + ((j & ((1 << 26) - 1)) + 0.5) * float(_GOLDEN)) % 1


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with size long: the number of words of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            sizes = np.diff(word_spans(batch.column(batch.schema.get_field_index(text)))[3])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], schema=pa.schema([*batch.schema, pa.field("size", pa.int64())]))

    docs = docs.drop("size")
    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField("size", T.LongType())]))


def plan_sources(sized: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, ratio: float = RATIO, limit: int = LIMIT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a source: number, source, source_size, docs, target, blocks."""
    spark = sized.sparkSession
    rows = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["words"] for r in rows], [w for _, w in zip(rows, cycle(weights))], ratio, limit)
    listed = [(k, r["source"], r["words"], r["docs"], t, -(-r["words"] // block_words)) for k, (r, t) in enumerate(zip(rows, goal, strict=True))]
    return spark.createDataFrame(listed, "number int, source string, source_size long, docs long, target double, blocks long")


def blocks_wanted(target: float, words: int, blocks: int, block_words: int = BLOCK_WORDS, limit: int = LIMIT) -> int:
    """How many blocks, round after round, come nearest to the target; the last block of a round holds what is left of the source's words.  One at least, of a source with words."""
    if not blocks:
        return 0
    rounds = min(int(target // words), limit)
    left = target - rounds * words
    n = min(int(left // block_words), blocks)
    nearest = min((n, min(n + 1, blocks)), key=lambda k: abs(min(k * block_words, words) - left))
    return max(1, min(rounds * blocks + nearest, limit * blocks))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS, limit: int = LIMIT) -> DataFrame:
    """The slots: slot long (their order), number int (the source's), rank long, block long, round long.  A source gets blocks_wanted()."""
    spark = sources.sparkSession
    rows = sorted(sources.collect(), key=lambda r: r["number"])
    goal = np.array([r["target"] for r in rows], float)
    total = math.ceil(goal.sum() / block_words) if len(rows) else 0
    ends = np.cumsum(goal) / goal.sum() if total else np.zeros(0)
    parts = max(1, min(-(-total // CHUNK), MAX_PARTS))

    def drawn(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        j = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, total))
        return j, np.minimum(np.searchsorted(ends, golden(j), "right"), len(ends) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                numbers, n = np.unique(drawn(chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(n), chunk)), "number": pa.array(numbers.astype(np.int32)), "n": pa.array(n)})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                j, of = drawn(row["chunk"])
                before = np.zeros(len(ends), np.int64)
                for x in row["sources"]:
                    before[x["number"]] = x["before"]
                order = np.argsort(of, kind="stable")
                starts = np.searchsorted(of[order], np.arange(len(ends)))
                ranks = np.empty(len(j), np.int64)
                ranks[order] = np.arange(len(j)) - starts[of[order]] + before[of[order]]
                yield pa.RecordBatch.from_pydict({"slot": pa.array(j), "number": pa.array(of.astype(np.int32)), "rank": pa.array(ranks)})

    # slots are drawn twice and never shuffled: what moves is one row a chunk and source
    counts = spark.range(0, -(-total // CHUNK), 1, parts).mapInArrow(count, "chunk long, number int, n long")
    before = counts.select("chunk", "number", (F.sum("n").over(Window.partitionBy("number").orderBy("chunk")) - F.col("n")).alias("before"))
    gathered = before.repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("number", "before")).alias("sources"))
    ranked = gathered.mapInArrow(rank, "slot long, number int, rank long")
    # the points give a source a few slots more or less than its target takes: more are left out, and the last ranks get slots after the others
    got = {r["number"]: r["n"] for r in counts.groupBy("number").agg(F.sum("n").alias("n")).collect()}  # at most MAX_SOURCES rows
    own = [(r["number"], r["blocks"], blocks_wanted(r["target"], r["source_size"], r["blocks"], block_words, limit), got.get(r["number"], 0)) for r in rows]
    sizes = spark.createDataFrame(own, "number int, blocks long, wanted long, got long")
    late = sizes.filter("got < wanted").select("number", F.explode(F.sequence("got", F.col("wanted") - 1)).alias("rank"))
    late = late.select((total + F.col("number") + F.col("rank") * len(own)).alias("slot"), "number", "rank")
    slots = ranked.unionByName(late).join(F.broadcast(sizes.select("number", "blocks", "wanted")), "number").filter(F.col("rank") < F.col("wanted"))
    return slots.select("slot", "number", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("round"))


def cut_blocks(sized: DataFrame, sources: DataFrame, *, row: str = "row", key: str = "doc_id", source: str = "source", block_words: int = BLOCK_WORDS, seed: int = 4) -> DataFrame:
    """Pieces (row, number, block, words): each source's documents in a drawn order, end to end, cut every ``block_words`` words."""
    named = F.broadcast(sources.select("number", F.col("source").alias("_source"), F.greatest(F.col("docs") / BUCKET_DOCS, F.lit(1)).cast("long").alias("_buckets")))
    drawn = F.xxhash64(F.coalesce(F.col(key), F.col(row)), F.lit(seed))  # rows without an id are spread by their numbers
    docs = sized.filter(F.col("size") > 0).join(named, F.col(source).eqNullSafe(F.col("_source"))).select(row, F.col(key).alias("_key"), "size", "number", drawn.alias("_draw"), "_buckets")
    docs = docs.withColumn("_bucket", F.floor((F.shiftrightunsigned("_draw", 33) / F.lit(float(1 << 31))) * F.col("_buckets")))
    sums = docs.groupBy("number", "_bucket").agg(F.sum("size").alias("_n"))
    before = sums.select("number", "_bucket", (F.sum("_n").over(Window.partitionBy("number").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    run = Window.partitionBy("number", "_bucket").orderBy("_draw", "_key", "size", row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("_upto", F.sum("size").over(run)).join(before, ["number", "_bucket"])
    docs = docs.withColumn("_end", F.col("_before") + F.col("_upto")).withColumn("_start", F.col("_end") - F.col("size"))
    block = F.explode(F.sequence(F.floor(F.col("_start") / block_words), F.floor((F.col("_end") - 1) / block_words)))
    cut = docs.select(row, "number", "_start", "_end", block.alias("block"))
    return cut.select(row, "number", "block", (F.least("_end", (F.col("block") + 1) * block_words) - F.greatest("_start", F.col("block") * block_words)).alias("words"))


def mix_sources(docs: DataFrame, *, key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, ratio: float = RATIO, limit: int = LIMIT, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """``docs`` must have size, as with_sizes gives it.  Returns (docs, cut off in the shared folder, with row, source_size, target,
    rounds array<long>, slots array<long>; sources).  ``rounds[e]`` is how many words of the document, from its first, round e takes, ``slots[e]`` the slot of
    the first of them."""
    # the row numbers are written with the rows: no later computation can deal them differently
    kept = save(docs.withColumn("row", F.monotonically_increasing_id()), "mixing")
    sources = plan_sources(kept, source, weights, ratio, limit, block_words)
    # Spark takes drawn slots for as few as their chunks: without the hint it would broadcast them
    slots = schedule(sources, block_words, limit).select("number", "block", "round", "slot").hint("merge")
    taken = cut_blocks(kept.select("row", key, source, "size"), sources, key=key, source=source, block_words=block_words).join(slots, ["number", "block"])
    own = lambda e, c: F.when(F.col("round") == e, F.col(c))
    rounds = taken.groupBy("row").agg(*[F.coalesce(F.sum(own(e, "words")), F.lit(0)).alias(f"r{e}") for e in range(limit)], *[F.min(own(e, "slot")).alias(f"s{e}") for e in range(limit)])
    rounds = rounds.select("row", F.array(*[f"r{e}" for e in range(limit)]).alias("rounds"), F.array(*[f"s{e}" for e in range(limit)]).alias("slots"))
    named = F.broadcast(sources.select(F.col("source").alias("_source"), "source_size", "target"))
    none = F.array(*[F.lit(0).cast("long")] * limit)
    mixed = kept.join(named, F.col(source).eqNullSafe(F.col("_source"))).drop("_source").join(rounds, "row", "left").withColumns({"rounds": F.coalesce("rounds", none), "slots": F.coalesce("slots", F.array(*[F.lit(None).cast("long")] * limit))})
    return mixed, sources


def take_mix(mixed: DataFrame, columns: list[str], *, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The mix as documents, in order of their slots: a row for each round that takes words of a document, with the text cut after the last
    word taken.  Rows are range-partitioned and sorted, so files that are written of them are in that order too."""
    rows = mixed.select("*", F.posexplode("rounds").alias("_round", "_take")).filter("_take > 0").withColumn("_slot", F.element_at("slots", F.col("_round") + 1)).select(*dict.fromkeys([*columns, text]), "size", "row", "_take", "_slot")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            place = batch.schema.get_field_index(text)
            take = batch.column(batch.schema.get_field_index("_take")).to_numpy()
            part = np.flatnonzero(take < batch.column(batch.schema.get_field_index("size")).to_numpy())
            texts = batch.column(place)
            if len(part):
                some = texts.take(pa.array(part))
                data, _, ends, first = word_spans(some)
                base = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(some)), dtype=np.int64)])
                whole = texts.to_pylist()
                for k, b, f, n in zip(part.tolist(), base, first, take[part]):
                    whole[k] = data[b : ends[f + n - 1]].tobytes().decode()
                texts = pa.array(whole, texts.type)
            yield pa.RecordBatch.from_arrays([texts if k == place else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    if n_chars in columns:
        length = lambda: F.when(F.col("_take") < F.col("size"), F.length(text)).otherwise(F.col(n_chars)).cast(rows.schema[n_chars].dataType)
        rows = rows.mapInArrow(cut, rows.schema).withColumn(n_chars, length())
    else:
        rows = rows.mapInArrow(cut, rows.schema)
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_slot", "row").sortWithinPartitions("_slot", "row").select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_sizes(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    mixed, _ = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", F.aggregate("rounds", F.lit(0).cast("long"), lambda a, n: a + n).alias("taken"), "source")


QUERIES = {"op4_mixing": op4_mixing}
SQL: dict[str, str] = {}
