"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A *spot signature* is an anchor (a common word, or the beginning of the text) with the next ``CHAIN`` content words after it (words
that are no common words; fewer at the end).  Common words are told by what is left without ASCII punctuation at their edges.  A stretch
of more than ``GAP`` content words without an anchor gets further ones: words whose hash is 0 mod ``SPARSE``, and where that leaves such
a stretch, every word of it; so does a text without common words that is no longer than that.  So no text is cut to its beginning.  A document's fingerprint is the set of its signatures as sorted 32-bit hashes, in
hexadecimal; likeness is the Jaccard resemblance of two sets.  Moved or added passages
change only their own signatures.

matches() compares fingerprints: partitioned by set length, and within a partition by shared signatures, with the bound on
Jaccard that lengths give checked before the sets are.

Null texts count as empty and have the empty fingerprint, which is like itself (1) and like nothing else (0).  Rows with the same id
follow each other in a fixed order; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import HASHED_BYTES, U64, mix, pieces, read_table, save, span_hashes, word_hashes, word_spans

CHAIN, GAP, SPARSE = 2, 4, 4
ANCHORS = "the a an of to and in is that it on for was with as be this by at are from der die das und von zu den ein nicht le la les de des et un une du que el los las y en por".split()
_START = U64(0x5107)
_FIRST = -(1 << 63)


def _anchor_hashes() -> np.ndarray:
    return np.sort(word_hashes(pa.array(ANCHORS))[0])


_anchors = _anchor_hashes()
_LETTER = np.arange(256) > 127
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _bare_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words without punctuation at their edges; a word of punctuation alone stays as it is."""
    letters = np.append(np.flatnonzero(_LETTER[data]), len(data))
    at = np.searchsorted(letters, starts)
    to = np.searchsorted(letters, ends)
    some = to > at
    return span_hashes(data, np.where(some, letters[np.minimum(at, len(letters) - 1)], starts), np.where(some, letters[np.maximum(to - 1, 0)] + 1, ends))


def _runs(anchor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words without an anchor between them each word stands among, in its row; 0 for anchors."""
    begins = anchor.copy()
    begins[first[:-1][np.diff(first) > 0]] = True
    group = np.cumsum(begins)
    return np.where(anchor, 0, np.bincount(group, ~anchor, int(group[-1]) + 1)[group]) if len(anchor) else np.zeros(0)


def spot_sets(texts: list[str], chain: int = CHAIN) -> list[np.ndarray]:
    """Each text's distinct signatures, sorted."""
    data, starts, ends, first = word_spans(pa.array(texts, pa.string()))
    words, bare = span_hashes(data, starts, ends), _bare_hashes(data, starts, ends)
    n = len(texts)
    at = np.minimum(np.searchsorted(_anchors, bare), len(_anchors) - 1)
    anchor = _anchors[at] == bare
    content = np.flatnonzero(~anchor)
    full = np.flatnonzero(np.diff(first) > 0)
    counts = np.diff(first)
    lacking = np.repeat((np.bincount(np.repeat(np.arange(n), counts), anchor, n) == 0) & (counts <= GAP), counts)
    more = (_runs(anchor, first) > GAP) & (words % U64(SPARSE) == 0)
    more |= (_runs(anchor | more, first) > GAP) | lacking
    places = np.flatnonzero(anchor | more)
    row = np.concatenate([full, np.searchsorted(first, places, "right") - 1])
    after = np.concatenate([first[full], places + 1])
    with np.errstate(over="ignore"):
        h = np.concatenate([np.full(len(full), _START), np.where(anchor, bare, words)[places]]) * U64(0x9E3779B97F4A7C15)
        k = np.searchsorted(content, after)
        for j in range(chain):
            there = k + j < len(content)
            word = content[np.minimum(k + j, max(len(content) - 1, 0))] if len(content) else np.zeros(len(k), np.int64)
            there &= word < first[row + 1]
            h = mix(h + np.where(there, words[np.minimum(word, max(len(words) - 1, 0))], U64(1)) * U64(2 * j + 3)) if len(words) else h
    h = (h >> U64(32)).astype(np.uint32)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.split(h[keep], np.searchsorted(row[keep], np.arange(1, n))) if n else []


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard resemblance of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared)


def as_text(spots: np.ndarray) -> str:
    return spots.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spots array<long>) of every document."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=HASHED_BYTES):
            sets = spot_sets([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "spots"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(take, "doc_id long, spots array<long>")


def matches(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of all pairs of *different* non-empty fingerprints at least ``threshold`` alike, a and b the smallest ids that have them (null where
    only documents without an id do), a first; equal fingerprints are one class, so groups of copies cost nothing.  ``prints`` as fingerprints() gives it.

    A class has its rarest signatures as its prefix, so that frequent ones bring few pairs together."""
    classes = prints.filter(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("id")).withColumns({"n": F.size("spots"), "class": F.xxhash64("spots")})
    classes = save(classes, "spot-classes")
    # lengths a and b >= a can only reach the threshold if b <= a / threshold: neighbouring partitions on a log scale
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(threshold)))).cast("int")
    each = classes.select("class", "n", part.alias("part"), F.explode("spots").alias("spot"))
    often = each.groupBy("spot").agg(F.count("*").alias("times"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("times", "spot"))), lambda x: x["spot"])
    keep = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
    slim = each.join(often, "spot").groupBy("class", "n", "part").agg(order.alias("spots")).select("class", "n", "part", F.explode(F.slice("spots", 1, keep)).alias("spot"))
    left = slim.select(F.col("class").alias("a"), F.col("n").alias("na"), "part", "spot")
    right = slim.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "spot")
    near = (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (F.col("na") <= F.col("nb")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["part", "spot"]).filter(near).select("a", "b").distinct()
    sets = lambda side: classes.select(F.col("class").alias(side), F.col("id").alias(f"id_{side}"), F.col("spots").alias(f"s{side}"))
    pairs = pairs.join(sets("a"), "a").join(sets("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    first = F.col("id_a").isNull() | (F.col("id_b").isNotNull() & (F.col("id_a") <= F.col("id_b")))
    told = pairs.select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("a"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("b"), (shared / (F.size("sa") + F.size("sb") - shared)).alias("likeness"))
    return told.filter(F.col("likeness") >= threshold)


def runs(rows: Iterator[tuple[tuple, int]]) -> Iterator[list[tuple]]:
    """Of sorted ((range, whether it is the next range's first, ...), bytes): lists of a range's documents, each with one more that only follows, so
    that a list and its edits are hashed at once."""
    held, size = [], 0
    for row, n in rows:
        if held and (held[-1][1] or held[-1][0] != row[0]):  # the range is over, or more of its tail follows
            if held[-1][0] == row[0]:
                continue
            if len(held) > 1:
                yield held
            held, size = [], 0
        held.append(row)
        size += n
        if size > HASHED_BYTES // 2 and len(held) > 1:
            yield held
            held, size = held[-1:], n
    if len(held) > 1:
        yield held


def compare_with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edit (its latter half replaced by the beginning of the next document) and the next's.

    Documents are dealt into ranges of the id, once and with compressed texts; the first of each range is dealt to the range before, too."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)).alias("id"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10_000).alias("cuts")).first()["cuts"] or []
    cuts = np.unique(np.array(cuts, np.int64))
    bucket = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]).cast("array<long>"), lambda c: c <= F.col("id")))
    heads = {r["bucket"]: r["id"] for r in rows.select(bucket.alias("bucket"), "id").groupBy("bucket").agg(F.min("id").alias("id")).collect()}  # one row a range
    ranges = np.array(sorted(heads), np.int64)
    before = {heads[int(b)]: int(ranges[k - 1]) for k, b in enumerate(ranges)}
    packed = pa.schema([("bucket", pa.int64()), ("tail", pa.bool_()), ("id", pa.int64()), ("packed", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in pieces(batches):
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = pack((t or "").encode())
                out.append((int(np.searchsorted(cuts, i, "right")), False, i, data))
                if i in before:
                    out.append((before[i], True, i, data))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), packed, strict=True)], schema=packed)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for b, tail, i, data in zip(*batch.columns, strict=True):
                text = unpack(data.as_py())
                yield (b.as_py(), tail.as_py(), i.as_py(), text.decode()), len(text)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compared(held: list[tuple]) -> pa.RecordBatch:
        """``held`` has documents of a range and, last, one more that only follows."""
        plain = [t for _, _, _, t in held]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(plain, plain[1:])]
        sets = spot_sets(plain + edited)
        own, changed = sets[: len(plain)], sets[len(plain) :]
        ids = [None if i == _FIRST else i for _, _, i, _ in held[:-1]]
        sums = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        columns = ids, [len(t) for t in plain[:-1]], sums, map(as_text, own[:-1]), map(as_text, changed), [likeness(a, b) for a, b in zip(own, changed)], [likeness(a, b) for a, b in zip(own, own[1:])]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(compared, runs(texts(batches)))

    dealt = rows.mapInArrow(deal, "bucket long, tail boolean, id long, packed binary").repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "tail", "id", "packed")
    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_spotsigs": op8_spotsigs}
SQL: dict[str, str] = {}
