"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by their number of shingles (powers of two).  For a partition up to ``h`` shingles, documents are cut into
windows of ``2 h`` shingles, ``h`` apart, so that an item that stands in a document stands whole in some window, whatever the
document's length: its containment becomes a resemblance that MinHash can see.  Signatures are one-permutation minima: the
least hash in each of ``BINS`` ranges of hash space.  An item and a window that share a minimum are candidates; a candidate counts if at least
``threshold`` of the item's distinct shingles (5 words) are among those of the whole document.  With an item of n shingles
about n bins hold one of its own minima, so a leak that keeps four fifths is missed with a chance below 1e-9 from 20 shingles on.

Items are broadcast in slices of at most ``SLICE_BYTES`` of text, each slice a pass over the documents; documents are never shuffled.
Null and empty texts have no shingles and match nothing; an item of under 5 words is one shingle and matches only documents of just
those words; repeated documents or items give repeated rows; empty tables give no rows; other columns aren't read by
find_leaks and pass through without_leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import U64, distinct_by_row, pieces, read_table, save, shingles, word_hashes

WORDS, THRESHOLD, BINS = 5, 0.8, 256
SLICE_BYTES = 32 << 20
_BIN_SHIFT = U64(64 - BINS.bit_length() + 1)


class Items:
    """Distinct shingles and minima of test items, by size partition."""

    def __init__(self, texts: list[str | None], words: int):
        self.values, self.first = distinct_by_row(*shingles(*word_hashes(pa.array(texts, pa.string())), words))
        self.sizes = np.diff(self.first)
        rows = np.flatnonzero(self.sizes)
        band = np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(int)
        self.partitions = []
        for b in np.unique(band[rows]):
            own = rows[band[rows] == b]
            minima = [self._minima(self.values[self.first[k] : self.first[k + 1]]) for k in own]
            values, of = np.concatenate(minima), np.repeat(own, [len(m) for m in minima])
            order = np.argsort(values, kind="stable")
            self.partitions.append((1 << int(b), values[order], of[order]))

    @staticmethod
    def _minima(values: np.ndarray) -> np.ndarray:
        """The least value of each bin, of sorted values."""
        bins = values >> _BIN_SHIFT
        keep = np.ones(len(values), bool)
        keep[1:] = bins[1:] != bins[:-1]
        return values[keep]

    def candidates(self, values: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a minimum in some window; ``values`` are shingles in order of the text."""
        found: set[tuple[int, int]] = set()
        for step, minima, of in self.partitions:
            at = np.minimum(np.searchsorted(minima, values), len(minima) - 1)
            hits = np.flatnonzero(minima[at] == values)  # only windows with one of these can share a minimum
            rows = np.searchsorted(first, hits, "right") - 1
            last = np.maximum(0, -(-(first[rows + 1] - first[rows]) // step) - 2)  # windows of 2 steps cover the row's end from here
            place = (hits - first[rows]) // step
            windows = {(int(r), int(w)) for r, p, m in zip(rows, place, last) for w in (min(p, m), min(max(p - 1, 0), m))}
            for row, w in windows:
                lo = first[row] + w * step
                own = self._minima(np.unique(values[lo : min(lo + 2 * step, first[row + 1])]))
                k = np.searchsorted(minima, own)
                there = np.flatnonzero(minima[np.minimum(k, len(minima) - 1)] == own)
                for a, b in zip(k[there], np.searchsorted(minima, own[there], "right")):
                    found.update((row, int(x)) for x in of[a:b])
        return found

    def leaks(self, text: pa.Array, words: int, threshold: float) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of the rows that contain an item."""
        values, first = shingles(*word_hashes(text), words)
        pairs = sorted(self.candidates(values, first)) if len(self.values) else []
        out, row, own = [], -1, None
        for r, item in pairs:
            if r != row:
                row, own = r, np.unique(values[first[r] : first[r + 1]])
            mine = self.values[self.first[item] : self.first[item + 1]]
            shared = int((own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine).sum())
            if shared >= threshold * len(mine) - 1e-9:
                out.append((r, item, shared))
        return out


def _slices(items: DataFrame, item: str, text: str, words: int) -> Iterator[tuple[list, Items, bool]]:
    """Bounded parts of the test items: their ids and numbers of repeats, their shingles, and whether there are several parts.  Repeated items stand once."""
    once = items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).groupBy("item", "text").agg(F.count("*").alias("times"))
    size = once.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-size // SLICE_BYTES)
    for k in range(n):
        rows = once.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        if rows:
            yield [(r["item"], r["times"]) for r in rows], Items([r["text"] for r in rows], words), n > 1


def find_leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item: str = "item_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every document and test item that it contains.

    Where items fill several slices, each slice's rows are written to the shared folder and its broadcast is released before the next."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("times", pa.int64())])
    spark = docs.sparkSession
    found = []
    for names, part, several in _slices(items, item, text, words):
        shared = spark.sparkContext.broadcast((names, part))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, own = shared.value
            for batch in pieces(batches):
                rows = own.leaks(batch.column(1), words, threshold)
                keys = batch.column(0).take(pa.array([r for r, _, _ in rows], pa.int64()))
                columns = [[names[k][0] for _, k, _ in rows], [int(own.sizes[k]) for _, k, _ in rows], [n for _, _, n in rows], [names[k][1] for _, k, _ in rows]]
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, pa.int64()) for c in columns]], schema=schema)

        rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(scan, "doc_id long, item_id long, n_shingles long, n_shared long, times long")
        if several:
            rows = save(rows, "leaks")
            shared.destroy()
        found.append(rows)
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_shared long, containment double")
    out = reduce(DataFrame.unionByName, found)
    each = F.explode(F.array_repeat(F.lit(True), F.col("times").cast("int"))).alias("each")
    return out.select("*", each).select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, *, item: str = "item_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no test item; all columns pass as they are."""
    for _, part, several in _slices(items, item, text, words):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text):
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _, _ in shared.value.leaks(batch.column(batch.schema.get_field_index(text)), words, threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
        if several:
            docs = save(docs, "without-leaks")
            shared.destroy()
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL = {
    "op1_decontaminate": r"""
with w as (select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
ds as (select distinct r, doc_id, array_to_string(w[i:i+4], ' ') s from (select r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from w where len(w) > 0)),
b as (select row_number() over () b, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from benchmark),
bs as (select distinct b, item_id, array_to_string(w[i:i+4], ' ') s from (select b, item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from b where len(w) > 0)),
n as (select b, count(*) n from bs group by b)
select doc_id, item_id, any_value(n)::bigint n_shingles, count(*)::bigint n_shared, count(*) / any_value(n)::double containment
from bs join ds using (s) join n using (b) group by b, item_id, r, doc_id having count(*) >= 0.8 * any_value(n)
"""
}
