"""Hard negatives by product quantisation with a bound that holds, and exact reranking.

Vectors are turned to whole numbers.  Codebooks (one for each pair of components) are fitted on about ``SAMPLE_VALUES`` values of rows drawn by a hash; then
every row is stored with its code, its *reach* (the norm of what the code leaves, widened for rounding) and its vector.  An anchor's score with a row is what
its lookup table sums up for the code, give or take the anchor's norm times the reach (Cauchy-Schwarz).  So a task knows from codes alone which rows can be among the
best of a window; their scores are then computed exactly from whole numbers, and only the best leave the task.

Two searches follow one another: an anchor's positives are the best rows of its label; for each of them the window of scores is known, and the negatives are
the best rows of other labels within.  Each search first goes through one row in ``OPENING``: its exact results are floors for the whole search, so that
few rows leave each task.  Anchors are broadcast in slices of about ``SLICE_BYTES``, one at a time; all rows pass by each slice where they lie and never move.

Rows with a null label or vector or a null or non-finite component take no part, nor do those whose squared norm is over a long (2 ** 63).  Components that a shorter vector lacks
count as 0.  Ties go to the smaller id, null ids last; rows are told apart by their place, so repeated rows (of an anchor too) each stand for themselves.  Labels
are whole numbers.  An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.llm.common import Scratch, read_table

WIDTH, CENTRES, SAMPLE_VALUES, LLOYD = 2, 256, 1 << 19, 6
OPENING, SLICE_BYTES, TILE, SCALE = 16, 16 << 20, 64, 256
POSITIVES, NEGATIVES, LEAST_SHARE = 5, 5, (80, 100)
LARGEST = 2.0**63
NAMELESS = np.iinfo(np.int64).max  # where null ids stand in ties


def whole_vectors(rows: DataFrame, *, key: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(key, label, vector) of the rows that take part, components as whole numbers."""
    kept = rows.select(F.col(f"`{key}`").cast("long").alias("key"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("_x"))
    finite = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST / scale))
    kept = kept.filter(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform("_x", lambda v: F.floor(v * scale).cast("double"))
    return kept.select("key", "label", whole.alias("vector")).filter(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v) < LARGEST)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The lists as rows of a matrix, zeros where they end earlier."""
    offsets = column.offsets.to_numpy()
    n = np.diff(offsets)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(n), size))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], n)] = values
    return out


@dataclass
class Codebook:
    """For each run of ``WIDTH`` components, its centres; vectors of ``size`` components are padded with zeros to whole runs."""

    size: int
    centres: np.ndarray  # (runs, CENTRES, WIDTH)

    @property
    def padded(self) -> int:
        return self.centres.shape[0] * self.centres.shape[2]

    @classmethod
    def fit(cls, sample: np.ndarray, size: int) -> Codebook:
        """Lloyd's iterations from drawn rows, run by run."""
        runs = -(-max(size, 1) // WIDTH)
        draw, found = np.random.default_rng(0), np.zeros((runs, CENTRES, WIDTH), np.float32)
        padded = np.zeros((len(sample), runs * WIDTH))
        padded[:, :size] = sample
        for k in range(runs if len(sample) else 0):
            own = padded[:, k * WIDTH : (k + 1) * WIDTH]
            centres = own[draw.choice(len(own), CENTRES, replace=len(own) < CENTRES)]
            for _ in range(LLOYD):
                nearest = _nearest(own, centres)
                n = np.bincount(nearest, minlength=CENTRES)
                sums = np.stack([np.bincount(nearest, own[:, j], CENTRES) for j in range(WIDTH)], 1)
                centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            found[k] = centres
        return cls(size, found)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and reaches."""
        codes, left = np.zeros((len(vectors), len(self.centres)), np.uint8), np.zeros(len(vectors))
        for k, centres in enumerate(self.centres.astype(float)):
            own = vectors[:, k * WIDTH : (k + 1) * WIDTH]
            codes[:, k] = _nearest(own, centres)
            left += ((own - centres[codes[:, k]]) ** 2).sum(1)
        reach = np.sqrt(left)
        # what single precision may lose in the table and its sums, generously
        return codes, reach + 1e-5 * (np.sqrt((vectors * vectors).sum(1)) + reach)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, runs, CENTRES): what each code of a run adds to the score."""
        split = anchors.astype(np.float32).reshape(len(anchors), len(self.centres), WIDTH)
        return np.einsum("amw,mcw->amc", split, self.centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


@dataclass
class Index:
    """All rows with codes, reaches and vectors, as a table in the shared folder: row, key, label, code, reach, vector."""

    rows: DataFrame
    codebook: Codebook
    kind: str  # of the stored whole numbers
    exact: str  # of their sums


def build_index(vectors: DataFrame, scratch: Scratch, *, sample_values: int = SAMPLE_VALUES) -> Index:
    """``vectors`` as whole_vectors() gives them."""
    top = vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("size"), F.coalesce(F.max(F.array_max(F.transform("vector", F.abs))), F.lit(0.0)).alias("most"), F.coalesce(F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)), F.lit(0.0)).alias("norm")).first()
    size = top["size"]
    drawn = vectors.orderBy(F.xxhash64("key", "vector")).limit(max(CENTRES, sample_values // max(size, 1))).select("vector").toArrow().column(0).combine_chunks()
    book = Codebook.fit(_matrix(drawn, size), size)
    kind = next((k for k, limit in (("<i2", 1 << 15), ("<i4", 1 << 31)) if top["most"] < limit), "<i8")
    names = ["row", "key", "label", "code", "reach", "vector"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.zeros((n, book.padded))
            x[:, :size] = _matrix(batch.column(2), size)
            codes, reach = book.encode(x)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, x.astype(kind))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), batch.column(0), batch.column(1), packed[0], pa.array(reach), packed[1]], names=names)
            at += n

    rows = scratch.save(vectors.mapInArrow(encode, "row long, key long, label long, code binary, reach double, vector binary"), "index")
    return Index(rows, book, kind, "f8" if top["norm"] < 2.0**53 else "longdouble")


@dataclass
class Queries:
    """What is searched for: query k wants the best rows for anchor ``of[k]`` with scores from ``least[k]`` to ``most[k]``; ``floor[k]``: the score of some
    row that is among its best, or -inf."""

    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    of: np.ndarray
    least: np.ndarray
    most: np.ndarray
    floor: np.ndarray
    same: bool  # of the anchor's label, or of others


def _fixed(column: pa.Array, kind: str) -> np.ndarray:
    """Binaries of one length as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def search(index: Index, rows: DataFrame, asked: Queries, wanted: int) -> DataFrame:
    """(query, score, key, row) of the ``wanted`` best rows of each query: score downwards, then key, then row."""
    spark, book, kind, exact = rows.sparkSession, index.codebook, index.kind, np.dtype(index.exact)
    sent = spark.sparkContext.broadcast(asked)
    names = ["query", "score", "key", "row"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        anchors = q.vectors.astype(exact)
        norms = np.sqrt((anchors.astype(float) ** 2).sum(1))
        floor = q.floor.astype(exact)
        order = np.argsort(q.of, kind="stable")
        first = np.searchsorted(q.of[order], np.arange(len(q.rows) + 1))
        best = tuple(np.zeros(0, t) for t in (np.int64, exact, np.int64, np.int64, bool))  # query, score, key, row, without id

        def candidates(at: int, batch: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(queries, places in the batch) of what may be among the best, for a tile of anchors."""
            row, label, code, reach = batch
            tile = slice(at, min(at + TILE, len(q.rows)))
            tables = book.tables(anchors[tile])
            score = np.zeros((tables.shape[0], len(row)), np.float32)
            for k in range(tables.shape[1]):
                score += tables[:, k][:, code[:, k]]
            off = norms[tile, None] * reach
            low, high = score - off, score + off
            fits = (q.labels[tile, None] == label) == q.same
            fits &= q.rows[tile, None] != row
            for j in range(int((first[tile.start + 1 : tile.stop + 1] - first[tile.start : tile.stop]).max(initial=0))):
                has = np.flatnonzero(first[tile.start : tile.stop] + j < first[tile.start + 1 : tile.stop + 1])
                own = order[first[tile.start : tile.stop][has] + j]
                most, least = q.most[own, None], np.maximum(q.least[own], floor[own]).astype(float)
                open_ = np.flatnonzero(floor[own] == -np.inf)
                if len(open_) and len(row) >= wanted:  # rows that are within for certain tell a floor
                    sure = np.where(fits[has[open_]] & (high[has[open_]] <= most[open_]), low[has[open_]], -np.inf)
                    least[open_] = np.maximum(least[open_], np.partition(sure, len(row) - wanted, axis=1)[:, len(row) - wanted])
                a, b = np.nonzero(fits[has] & (low[has] <= most) & (high[has] >= least[:, None]))
                yield own[a], b

        for batch in batches:
            if not batch.num_rows or not len(q.of):
                continue
            row, label, reach = (batch.column(k).to_numpy() for k in (0, 2, 4))
            nameless = np.asarray(batch.column(1).is_null())
            key = batch.column(1).fill_null(NAMELESS).to_numpy()
            code, vectors = _fixed(batch.column(3), "u1"), _fixed(batch.column(5), kind)
            for at in range(0, len(q.rows), TILE):
                for own, place in candidates(at, (row, label, code, reach)):
                    for k in range(0, len(own), 1 << 15):
                        a, b = own[k : k + (1 << 15)], place[k : k + (1 << 15)]
                        score = (anchors[q.of[a]] * vectors[b].astype(exact)).sum(1)
                        good = (score >= q.least[a]) & (score <= q.most[a]) & (score >= floor[a])
                        a, b, score = a[good], b[good], score[good]
                        if not len(a):
                            continue
                        best = tuple(np.concatenate(x) for x in zip(best, (a, score, key[b], row[b], nameless[b]), strict=True))
                        o = np.lexsort((best[3], best[2], best[4], -best[1], best[0]))
                        o = o[np.arange(len(o)) - np.searchsorted(best[0][o], best[0][o]) < wanted]
                        best = tuple(x[o] for x in best)
                        full = np.flatnonzero(np.bincount(best[0], minlength=len(floor)) == wanted)
                        floor[full] = np.maximum(floor[full], best[1][np.searchsorted(best[0], full, "right") - 1])
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1].astype(np.int64)), pa.array(best[2], mask=best[4]), pa.array(best[3])], names=names)

    found = rows.mapInArrow(look, "query long, score long, key long, row long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= wanted)


def _opened(index: Index, asked: Queries, wanted: int, opening: int) -> Queries:
    """The same queries with floors from one row in ``opening``."""
    first = search(index, index.rows.filter(F.pmod(F.xxhash64("row"), F.lit(opening)) == 0), asked, wanted).filter(F.col("rank") == wanted).select("query", "score").toArrow()
    floor = asked.floor.astype(index.exact)
    floor[first["query"].to_numpy()] = first["score"].to_numpy()
    return Queries(**{**asked.__dict__, "floor": floor})


def mine(index: Index, scratch: Scratch, *, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = LEAST_SHARE, anchors: Column | None = None, slice_bytes: int = SLICE_BYTES, opening: int = OPENING) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor (rows whose key is divisible by 100, unless ``anchors``
    tells) and each of its ``positives`` best rows of its label, the ``negatives`` best rows of other labels whose score is at most the positive's and at least
    ``share`` (a fraction) of it."""
    spark, out = index.rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    chosen = index.rows.filter(F.col("key") % 100 == 0 if anchors is None else anchors)
    slices = max(1, -(-chosen.count() * index.codebook.padded * 8 // slice_bytes))
    done = []
    for k in range(slices):
        own = chosen.filter(F.pmod(F.xxhash64("row"), F.lit(slices)) == k).select("row", "key", "label", "vector").toArrow()
        n = own.num_rows
        if not n:
            continue
        row, label = own["row"].to_numpy(), own["label"].to_numpy()
        vectors = _fixed(own["vector"].combine_chunks(), index.kind)
        asked = Queries(row, label, vectors, np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), np.full(n, -np.inf), True)
        found = search(index, index.rows, _opened(index, asked, positives, opening), positives).select("query", "key", "score").toArrow()  # bounded by the slice
        query, score = found["query"].to_numpy(), found["score"].to_numpy()
        least = np.array([-(-share[0] * int(s) // share[1]) for s in score], np.longdouble)
        most = score.astype(np.longdouble)
        asked = Queries(row, label, vectors, query, least.astype(index.exact), most.astype(index.exact), np.full(len(query), -np.inf), False)
        told = spark.createDataFrame(list(zip(range(len(query)), own["key"].take(pa.array(query)).to_pylist(), found["key"].to_pylist(), score.tolist(), strict=True)), "query long, anchor_id long, positive_id long, positive_score long")
        hard = search(index, index.rows, _opened(index, asked, negatives, opening), negatives)
        met = hard.join(F.broadcast(told), "query")  # five rows an anchor of the slice
        done.append(scratch.save(met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined"))
    if not done:
        return spark.createDataFrame([], out)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "hard-negatives")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = build_index(whole_vectors(read_table(spark, sf_dir, "embeddings"), key="vec_id", vector="embedding", label=label), scratch)
    return mine(index, scratch)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
SQL = {
    "op11_hard_negatives": """
with e as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id anchor_id, b.vec_id, a.label = b.label same, list_dot_product(a.v, b.v)::bigint score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as materialized (select anchor_id, vec_id positive_id, score positive_score from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) r from s where same) z where r <= 5)
select anchor_id, positive_id, r::int "rank", negative_id, positive_score, negative_score from (select p.*, s.vec_id negative_id, s.score negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) r
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * s.score and s.score <= positive_score) z where r <= 5"""
}
