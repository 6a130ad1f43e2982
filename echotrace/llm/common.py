"""What the operators share: the word rule, vectorised word hashes, and tables cut off in the shared folder.

A *word* is a run of bytes other than 0x20 and 0x09-0x0D; only A-Z are lower-cased.  Both rules work on UTF-8
bytes, so Python's ``bytes.split``/``bytes.lower``, the numpy code below and the SQL pattern ``[^\\x20\\x09-\\x0D]+``
agree on every text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: text that is hashed at once where memory counts: the arrays of it take some 40 bytes a byte
HASHED_BYTES = 1 << 19
U64 = np.uint64


def workdir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local folder in local mode (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{workdir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run under a folder of its own; those that later ones supersede are dropped, so that disk holds no more than a step needs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, new_path(spark, name), {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """As save(); another table of this name stays until it is dropped."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, but_last: bool = False) -> None:
        """Delete the tables of these names (all but the newest one, if asked); Spark then deletes the shuffle files of plans that nothing holds any more."""
        context = self.spark.sparkContext
        for name in names:
            paths = self.paths.get(name, [])
            gone, self.paths[name] = (paths[:-1], paths[-1:]) if but_last else (paths, [])
            for path in gone:
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        context._jvm.System.gc()


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """``needed`` columns, and all others as the struct ``_rest``, so that an operator's own names can't clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*[F.col(f"`{c}`") for c in needed], F.struct(*(rest or [F.lit(True).alias("none")])).alias("_rest"))


def unpacked(columns: list[str], *needed: str) -> list[Column]:
    """What to select to have ``columns`` again."""
    return [F.col(f"`{c}`") if c in needed else F.col("_rest").getField(c).alias(c) for c in columns]


def held_out(key: Column | str, modulus: int, rest: int) -> Column:
    """Whether the crc32 of the key as text leaves ``rest``; a null key counts as the empty text."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text (one row at least): bounds numpy's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        at, total = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_EXACT = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, hardly more: a worker holds them as long as it lives."""
    if n > len(_powers.get("base", ())):
        size = -(-int(n) // (1 << 16)) << 16
        _powers.clear()
        for name, x in (("base", _BASE), ("inverse", _INVERSE)):
            made = np.full(size, U64(x))
            made[0] = 1
            _powers[name] = np.cumprod(made, out=made)
    return _powers["base"], _powers["inverse"]


def word_spans(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(data, starts, ends, first)`` of a string array: the words of row i are ``first[i]:first[i+1]`` of starts and ends,
    which are byte places in data.  A null has no words."""
    if not pa.types.is_string(text.type):
        text = text.cast(pa.string())
    n = len(text)
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], np.uint8)[lo:hi] if buffers[2] is not None and hi > lo else np.zeros(0, np.uint8)
    offsets = offsets - lo
    solid = ~_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = solid
    edges = np.unique(offsets)
    before[edges] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    inner = edges[(edges > 0)] - 1
    after[inner] = False
    ends = np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return data, starts, ends, first


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased) and, for each row, where its words begin."""
    data, starts, ends, first = word_spans(text)
    return span_hashes(data, starts, ends), first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, exact: bool = False) -> np.ndarray:
    """The hash of ``data[s:e]`` for each s in starts and e in ends; A-Z are lower-cased unless ``exact``."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.take(_EXACT if exact else _BYTE, data, out=total[1:], mode="clip")
    total[1:] *= up[: len(data)]
    np.cumsum(total[1:], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and where each row's begin; a row with fewer words (but some) has all of them as one."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    if not at[-1]:
        return np.zeros(0, U64), at
    places = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
    short = np.repeat(n < k, count)
    out = np.zeros(at[-1], U64)
    length = np.repeat(n, count)
    with np.errstate(over="ignore"):
        for j in range(k):
            there = np.minimum(places + j, len(words) - 1)
            term = words[there] * U64((0x9E3779B97F4A7C15 * (2 * j + 3) ** 5 | 1) & (1 << 64) - 1)
            out = np.where(j < length, out + term, out)
        out += np.where(short, length, k).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out), at


def distinct_by_row(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats, and where each row's begin."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(first)))
