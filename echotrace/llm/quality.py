"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are ratios of characters and words over the whole text.  Standardised, they pass through ``FEATURES`` cosines with
normal frequencies, which approximate a Gaussian kernel; partitions sum X'X and X'y, the driver solves the ridge system, and
pool-adjacent-violators over a quarter of the labelled rows turns raw scores into frequencies of label 1.

At most about ``max_labelled`` labelled rows, drawn by a hash of the key, are learnt from.  Null texts count as empty; both are scored like any text.  Null
labels are left out and repeated ones all count.  With no labels every score is 0.5; with one kind of label, its value.
Extra columns aren't read; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.llm.common import held_out, pieces, read_table, save, word_hashes, word_spans

FEATURES, RIDGE, MAX_LABELLED, SEED = 384, 1.0, 200_000, 7
_CLASS = np.zeros(256, np.int64)  # 0: other punctuation
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b" \t")] = 4
_CLASS[list(b"\n\v\f\r")] = 5
_CLASS[list(b".,;:'-\"?()")] = 6
_CLASS[list(b"!")] = 7
_CLASS[list(b"|")] = 8
_CLASS[list(b"#$%&*@^~<>{}[]\\/=+_`")] = 9
_CLASS[128:] = 10
_CLASSES = 11


def statistics(text: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    n = len(text)
    data, starts, ends, first = word_spans(text)
    hashes, _ = word_hashes(text)
    sizes = np.array([len(t.encode()) if t else 0 for t in text.to_pylist()], np.int64)
    row = np.repeat(np.arange(n), sizes)
    counts = np.bincount(row * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    size = np.maximum(sizes, 1)
    words = np.diff(first)
    of = np.repeat(np.arange(n), words)
    per_word = lambda x: np.bincount(of, x, n) / np.maximum(words, 1)
    length = (ends - starts).astype(float)
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[new], runs)
    last = data[ends - 1] if len(ends) else data
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 10], 1)
    mean = per_word(length)
    return np.column_stack([
        np.log1p(sizes), np.log1p(words), mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), counts[:, 2] / letters, counts[:, 3] / size, counts[:, 6] / np.maximum(words, 1), counts[:, 7] / np.maximum(words, 1),
        counts[:, 8] / np.maximum(words, 1), counts[:, 9] / np.maximum(words, 1), counts[:, 5] / np.maximum(words, 1), counts[:, 10] / size, counts[:, 0] / size, per_word(same), distinct / np.maximum(words, 1), most / np.maximum(words, 1),
        per_word((length <= 3).astype(float)), per_word((length >= 12).astype(float)), per_word(np.isin(_CLASS[last], [7, 9]).astype(float)), np.log1p(distinct) / np.log1p(np.maximum(words, 1)),
    ])


N_STATISTICS = 20


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with statistics array<float>."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "statistics")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            x = statistics(batch.column(batch.schema.get_field_index(text))).astype(np.float32)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATISTICS, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), column], names=[*(f.name for f in keep), "statistics"])

    return docs.mapInArrow(measure, T.StructType([*keep, T.StructField("statistics", T.ArrayType(T.FloatType()))]))


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: middles of the pooled stretches of x and their mean values, which never fall."""
    blocks: list[list[float]] = []
    for a, s, w in zip(x, total, weight):
        blocks.append([s, w, a * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2] + a]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Scorer:
    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draw = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.frequencies = draw.standard_normal((d, FEATURES)) / np.sqrt(d / 2)
        self.phases = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequencies + self.phases), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), N_STATISTICS)


def fit(measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Scorer:
    """Learn from the labelled rows of ``measured`` (with key and statistics)."""
    known = labels.select(F.col(key), F.col(label).cast("double").alias("y")).filter("y is not null")
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(77)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # labels are drawn before they meet the documents; all tasks write the join, and what is then read is a bounded number of short rows
    drawn = known.filter(draw < max_labelled / max(n, 1))
    rows = measured.select(key, "statistics").join(drawn, key).select("statistics", "y", (F.pmod(F.xxhash64(F.col(key), F.lit(78)), F.lit(4)) == 0).alias("aside"))
    rows = save(rows, "quality-labels").coalesce(8)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            yield pa.RecordBatch.from_pydict({"sums": [np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]).tobytes()]})

    sums = [np.frombuffer(r[0]) for r in rows.mapInArrow(moments, "sums binary").collect()]
    if not sums:
        return Scorer(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    total = np.sum(sums, 0)
    mean = total[1 : N_STATISTICS + 1] / total[0]
    scorer = Scorer(mean, np.sqrt(np.maximum(total[N_STATISTICS + 1 :] / total[0] - mean**2, 0)))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = scorer.features(_matrix(batch.column(0)))
            sums += np.column_stack([x.T @ x, x.T @ np.asarray(batch.column(1))])
        yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()]})

    parts = rows.filter("not aside").select("statistics", "y").mapInArrow(normal, "sums binary").collect()
    total = np.sum([np.frombuffer(r[0]) for r in parts], 0).reshape(FEATURES + 1, FEATURES + 2)
    scorer.weights = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(FEATURES + 1), total[:, -1])

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"raw": pa.array(scorer.raw(_matrix(batch.column(0)))), "y": batch.column(1)})

    # the rows set aside, or all where there are none
    for aside in (rows.filter("aside"), rows):
        steps = aside.select("statistics", "y").mapInArrow(graded, "raw double, y double").groupBy(F.round(F.col("raw") * 2048).alias("bin")).agg(F.sum("y").alias("total"), F.count("*").alias("n"), F.avg("raw").alias("raw")).orderBy("bin").toPandas()
        if len(steps):
            scorer.steps = isotonic(steps["raw"].to_numpy(), steps["total"].to_numpy(), steps["n"].to_numpy(float))
            break
    return scorer


def score(measured: DataFrame, scorer: Scorer) -> DataFrame:
    """``measured`` with score double instead of the statistics."""
    shared = measured.sparkSession.sparkContext.broadcast(scorer)
    keep = [f for f in measured.schema.fields if f.name not in ("statistics", "score")]

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(_matrix(batch.column(batch.schema.get_field_index("statistics"))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), pa.array(s, pa.float64())], names=[*(f.name for f in keep), "score"])

    return measured.mapInArrow(grade, T.StructType([*keep, T.StructField("score", T.DoubleType())]))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    measured = save(with_statistics(docs), "quality-statistics")
    scorer = fit(measured.filter("not held_out"), read_table(spark, sf_dir, "labels"))
    return score(measured, scorer).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
