"""Jaccard join of documents on word shingles: exact links and their connected components.

Documents with equal sets are one *class*.  Classes are dealt into size bands, and hash space is cut into so many segments that two
sets of a band (or of it and the next) that reach the threshold must agree on one segment that isn't empty: they differ in at most
``d`` elements, and there are more than ``d`` segments and a few spare ones for empty segments.  (A set with more empty segments
than that also stands for its empty ones.)  A *tile* is all classes of a band that agree on a segment; a shared passage fills no
segment of its own, so tiles hold hardly anything but near copies.  Linked sets agree on more segments than one: a class in fewer tiles than
its sets' empty segments explain has no links and drops out (needs(), _core()).

Round 1 compares every class with a few leaders of its tiles (the classes in most tiles), exactly, on sorted arrays: groups of
thousands of near copies cost a few stars.  Round 2 takes only the tiles whose classes are still in several components: pairs that are together in
enough small tiles, and all pairs in large ones, which are cut into blocks.  The bits in which two hashed bitmaps differ bound their overlap from
above, and the pairs of different components that the bound leaves are compared exactly.  No link that matters to a component is missed, and pairs inside what is joined already are never written out.

Documents without words (or text) have the empty set, link with nothing and keep their own id.  Rows with the same id are judged
separately; equal rows are one class; an empty table gives no rows; other columns aren't read.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.llm.common import HASHED_BYTES, U64, Scratch, distinct_by_row, mix, packed, pieces, read_table, shingles, unpacked, word_hashes
from echotrace.llm.components import components

RATIO = 1.4
BLOCK_CLASSES = 4096
LEADERS, PAIR_TILE = 3, 32
CORE_ROUNDS = 2
BROADCAST_CLASSES = 1_000_000
SEEN_CLASSES = 1 << 20
BAND_BITS = 7


@lru_cache
def bands(threshold: Fraction, up_to: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least sizes of the bands, the most elements in which a linked pair can differ, and the number of segments."""
    low = [1]
    while low[-1] < up_to:
        low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
    low = np.array(low, np.int64)
    differ = np.array([int((1 - threshold) / threshold * (hi - 1)) for hi in low[1:].tolist()], np.int64)
    return low, differ, differ + 1 + np.ceil(0.1 * (differ + 1)).astype(np.int64)


def document_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted, and where they begin."""
    return distinct_by_row(*shingles(*word_hashes(text), words))


def class_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values), dtype=U64)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64)).astype(np.int64)


def banded(values: np.ndarray, first: np.ndarray, threshold: Fraction) -> Iterator[tuple]:
    """For the bands that rows stand in: the rows, their bands, their elements and the segments of these, of which (row, element) begins where."""
    low, differ, segments = bands(threshold)
    n = np.diff(first)
    top = np.searchsorted(low, n, "right") - 1  # -1: the empty set
    least = np.array([-(-threshold.numerator * int(x) // threshold.denominator) for x in n], np.int64)
    bottom = np.maximum(np.searchsorted(low, least, "right") - 1, 0)
    for back in range(int((top - bottom).max(initial=-1)) + 1):
        band = top - back
        own = np.flatnonzero((n > 0) & (band >= bottom))
        own = own[differ[band[own]] > 0]  # where no element may differ, only classes link
        if not len(own):
            continue
        count, b = n[own], band[own]
        at = np.cumsum(count) - count
        v = values[np.arange(count.sum()) + np.repeat(first[own] - at, count)]
        segment = ((v >> U64(32)) * np.repeat(segments[b], count).astype(U64)) >> U64(32)
        row = np.repeat(np.arange(len(own)), count)
        start = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (row[1:] != row[:-1])]))
        filled = np.bincount(row[start], minlength=len(own))
        yield own, b, v, row, segment, start, filled


def segment_keys(values: np.ndarray, first: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the tiles that each row belongs to; the last BAND_BITS bits of a key are its band."""
    _, differ, segments = bands(threshold)
    rows, keys = [], []
    for own, b, v, row, segment, start, filled in banded(values, first, threshold):
        s = segments[b]
        with np.errstate(over="ignore"):
            name = lambda r, g: b[r].astype(U64) * U64(0x9E3779B97F4A7C15) + g.astype(U64) * U64(0xC2B2AE3D27D4EB4F)  # noqa: B023, E731
            ends = lambda key, r: (key >> U64(BAND_BITS)) << U64(BAND_BITS) | b[r].astype(U64)  # noqa: B023, E731
            rows.append(own[row[start]])
            keys.append(ends(mix(np.add.reduceat(mix(v), start) + name(row[start], segment[start])), row[start]))
            for r in np.flatnonzero(filled <= differ[b]):
                lo = np.searchsorted(row[start], [r, r + 1])
                empty = np.setdiff1d(np.arange(s[r]), segment[start][lo[0] : lo[1]].astype(np.int64))
                at = np.full(len(empty), r)
                rows.append(own[at])
                keys.append(ends(mix(name(at, empty)), at))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def needs(values: np.ndarray, first: np.ndarray, threshold: Fraction) -> list[list[int]]:
    """For each row and band (the last BAND_BITS bits), in how many tiles of two classes or more a row is at least if it links with any in the band.

    Linked sets agree on all segments but ``differ``; of these, no more are empty than the row itself has.  A row that also stands for
    its empty segments is in one tile at least."""
    _, differ, segments = bands(threshold)
    out: list[list[int]] = [[] for _ in range(len(first) - 1)]
    for own, b, *_, filled in banded(values, first, threshold):
        least = np.maximum(filled - differ[b], 1)
        for r, x in zip(own.tolist(), ((least << BAND_BITS) | b).tolist(), strict=True):
            out[r].append(x)
    return out


def linked(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    """Whether two sorted sets are at least ``threshold`` alike, exactly."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * threshold.denominator < len(b) * threshold.numerator:
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared * threshold.denominator >= threshold.numerator * (len(a) + len(b) - shared)


def bitmap(values: np.ndarray) -> np.ndarray:
    """A hashed bitmap of a set as 64-bit words, a power of two of them: 8 to 16 bits an element, so that few elements share a bit."""
    words = 1 << max(2, int(np.ceil(np.log2(max(len(values), 1) / 8))))
    out = np.zeros(words, U64)
    bit = (values * U64(0x9E3779B97F4A7C15)) >> U64(64 - 6 - (words.bit_length() - 1))
    np.bitwise_or.at(out, (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that a set would have with fewer words: bits are taken from the top of the hash, so neighbours fall together."""
    while len(bits) > words:
        pairs = bits.reshape(-1, 2)
        half = []
        for part in (pairs[:, 0], pairs[:, 1]):
            part = (part | (part >> U64(1))) & U64(0x5555555555555555)
            for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
                part = (part | (part >> U64(shift))) & U64(mask)
            half.append(part)
        bits = half[0] | (half[1] << U64(32))
    return bits


def most_shared(p: np.ndarray, q: np.ndarray, n: int, m: int) -> int:
    """What two sets of n and m elements share at most, by their bitmaps: |A xor B| is at least the bits that differ."""
    words = min(len(p), len(q))
    return min((n + m - int(np.bitwise_count(fold(p, words) ^ fold(q, words)).sum())) // 2, n, m)


def tile_candidates(ids: np.ndarray, groups: np.ndarray, sizes: np.ndarray, bits: list[bytes], split: int, threshold: Fraction) -> list[tuple[int, int]]:
    """Pairs of different groups whose bitmaps leave room for a link; with ``split`` > 0, only between the first ``split`` members and the others."""
    maps = [np.frombuffer(b, U64) for b in bits]
    words = min(map(len, maps))
    maps = np.stack([fold(m, words) for m in maps])
    out = []
    for i in range(split or len(ids)):
        others = np.arange(split, len(ids)) if split else np.arange(i + 1, len(ids))
        others = others[groups[others] != groups[i]]
        if not len(others):
            continue
        # |A xor B| is at least the bits that differ, so |A and B| is at most half of what sizes and those bits leave
        apart = np.bitwise_count(maps[others] ^ maps[i]).sum(1, dtype=np.int64)
        total = sizes[others] + sizes[i]
        most = np.minimum((total - apart) // 2, np.minimum(sizes[others], sizes[i]))
        near = others[most * threshold.denominator >= threshold.numerator * (total - most)]
        out.extend((int(min(ids[i], x)), int(max(ids[i], x))) for x in ids[near])
    return out


def with_class(docs: DataFrame, words: int, threshold: Fraction | None = None) -> DataFrame:
    """``docs`` (with text, and no columns of these names) with n_shingles long, class long (null without words) and, given a threshold, needs array<long>."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=HASHED_BYTES):
            values, first = document_sets(batch.column(batch.schema.get_field_index("text")), words)
            n = np.diff(first)
            new = {"n_shingles": pa.array(n, pa.int64()), "class": pa.array(class_of(values, first), pa.int64(), mask=n == 0)}
            if threshold is not None:
                new["needs"] = pa.array(needs(values, first, threshold), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])

    added = [T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType())]
    if threshold is not None:
        added.append(T.StructField("needs", T.ArrayType(T.LongType())))
    return docs.mapInArrow(name, T.StructType([*docs.schema.fields, *added]))


def _tiles(docs: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """(tile, class) for the tiles of two classes or more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, limit=HASHED_BYTES):
            values, first = document_sets(batch.column(0), words)
            names = class_of(values, first)
            rows, keys = segment_keys(values, first, threshold)
            if len(seen) > SEEN_CLASSES:
                seen.clear()
            new = np.zeros(len(names), bool)  # a task sends the keys of a group of copies once
            for k, x in enumerate(names.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[k] = True
            keep = new[rows]
            yield pa.RecordBatch.from_pydict({"tile": pa.array(keys[keep]), "class": pa.array(names[rows[keep]])})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted rows, those of tiles with two classes or more."""
        last = least = last_class = None  # the tile at hand, its least class and the last one seen of it
        single = False  # whether that least class hasn't been given out yet
        for batch in batches:
            tile, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.ones(len(tile), bool)
            keep[1:] = (tile[1:] != tile[:-1]) | (name[1:] != name[:-1])
            keep[0] = not (last == tile[0] and last_class == name[0])
            tile, name = tile[keep], name[keep]
            if not len(tile):
                continue
            if last == tile[0]:
                tile, name, carried = np.append(last, tile), np.append(least, name), True
            else:
                carried = False
            start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            count = np.diff(np.append(start, len(tile)))
            out = np.repeat(count > 1, count)
            if carried and not single:
                out[0] = False
            yield pa.RecordBatch.from_pydict({"tile": pa.array(tile[out]), "class": pa.array(name[out])})
            single = count[-1] == 1 and not (carried and len(start) == 1 and not single)
            last, least, last_class = tile[-1], name[start[-1]], name[-1]

    keys = docs.mapInArrow(emit, "tile long, class long").repartition("tile").sortWithinPartitions("tile", "class")
    return keys.mapInArrow(shared, "tile long, class long")


def _sets_of(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(class, leaders, shingles array<long>) of the wanted (doc_id, class, leaders), from their texts; a class that only rows without an
    id hold is found by its name."""
    leading = wanted.schema["leaders"].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal rows with the same id meet in one task, so this is no more than its share of classes
        for batch in pieces(batches, limit=HASHED_BYTES):
            values, first = document_sets(batch.column(2), words)
            names = class_of(values, first)
            keep = [int(x) == y and y not in seen and not seen.add(y) for x, y in zip(names, batch.column(0).to_pylist(), strict=True)]
            arrays = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(values.astype(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), arrays], names=["class", "leaders", "shingles"]).filter(pa.array(keep, pa.bool_()))

    nameless = wanted.filter("doc_id is null").select("class", "leaders")
    wanted = wanted.filter("doc_id is not null")
    some, few = not nameless.isEmpty(), wanted.count() <= BROADCAST_CLASSES
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("class", "leaders", "text")
    if some:
        texts = texts.unionByName(with_class(docs.filter("doc_id is null"), words).join(nameless, "class").select("class", "leaders", "text").dropDuplicates(["class"]))
    return texts.mapInArrow(take, f"class long, leaders {leading}, shingles array<long>")


def _with_shares(pairs: DataFrame) -> DataFrame:
    """(class, leaders) of pairs (class, leader): the followers of a leader are dealt into shares, a few times the square root
    of their number each, and the leader goes to each share.
    ``leaders`` has (leader, share), few to a follower."""
    many = pairs.groupBy("leader").agg(F.ceil(F.sqrt(F.count("*")) / 4).alias("shares"))
    split = pairs.join(many.filter("shares > 1"), "leader", "left")
    followers = split.select("class", F.struct("leader", F.coalesce(F.pmod(F.xxhash64("class"), F.col("shares")), F.lit(0)).cast("long").alias("share")).alias("to"))
    each = many.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    leaders = each.select(F.col("leader").alias("class"), F.struct("leader", "share").alias("to"))
    return followers.unionByName(leaders).groupBy("class").agg(F.collect_list("to").alias("leaders"))


def _linked_with_leaders(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Links (a, b) of classes b with their leaders a; ``sets`` has class, shingles and leaders as _with_shares gives them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            out = []
            arrays = batch.column(3)
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if a == b:
                    leader, own = a, arrays[k].values.to_numpy().view(U64).copy()
                elif leader == a and linked(own, arrays[k].values.to_numpy().view(U64), threshold):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    dealt = sets.select(F.explode("leaders").alias("to"), "class", "shingles").select("to.leader", "to.share", "class", "shingles")
    dealt = dealt.repartition("leader", "share").sortWithinPartitions("leader", "share", F.col("class") != F.col("leader"), "class")
    return dealt.mapInArrow(check, "a long, b long").distinct()


def _bitmaps_of(sets: DataFrame) -> DataFrame:
    """(class, n, bits binary): the size and the hashed bitmap of each set."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [x.values.to_numpy().view(U64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in arrays], pa.int64()), pa.array([bitmap(x).tobytes() for x in arrays], pa.binary())], names=["class", "n", "bits"])

    return sets.select("class", "shingles").mapInArrow(draw, "class long, n long, bits binary")


def _needs(reps: DataFrame) -> DataFrame:
    """(class, band, need) of (class, needs)."""
    return reps.select("class", F.explode("needs").alias("need")).select("class", F.col("need").bitwiseAND((1 << BAND_BITS) - 1).alias("band"), F.shiftright("need", BAND_BITS).alias("need"))


def _pairs_of_small(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): of (tile, class, root), the classes of different roots that are together in as many tiles of a band as a link takes."""
    band = F.col("tile").bitwiseAND((1 << BAND_BITS) - 1).alias("band")
    x = members.select("tile", F.col("class").alias("a"), F.col("root").alias("root_a"))
    y = members.select("tile", F.col("class").alias("b"), F.col("root").alias("root_b"))
    met = x.join(y, "tile").filter("a < b and root_a <> root_b").groupBy("a", "b", band).agg(F.count("*").alias("n"))  # a class meets PAIR_TILE others of a tile at most
    least = _needs(reps)
    of = lambda c: least.select(F.col("class").alias(c), "band", F.col("need").alias(f"need_{c}"))
    return met.join(of("a"), ["a", "band"]).join(of("b"), ["b", "band"]).filter("n >= greatest(need_a, need_b)").select("a", "b").distinct()


def _within_bound(pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b) of the pairs (with n and bits of both) whose bitmaps leave room for a link."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [most_shared(np.frombuffer(p, U64), np.frombuffer(q, U64), n, m) * (threshold.denominator + threshold.numerator) >= threshold.numerator * (n + m) for p, q, n, m in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "bits_a", "bits_b", "n_a", "n_b").mapInArrow(judge, "a long, b long")


def _core(tiles: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Of (tile, class), the rows of classes that are in as many tiles of a band as any link in it takes.  Classes that merely share a passage
    drop out here; then the tiles that they leave with one class."""
    band = F.col("tile").bitwiseAND((1 << BAND_BITS) - 1).alias("band")
    least = _needs(reps)
    for _ in range(CORE_ROUNDS):
        enough = tiles.groupBy("class", band).agg(F.count("*").alias("n")).join(least, ["class", "band"]).filter("n >= need").select("class", "band")
        kept = tiles.withColumn("band", band).join(enough, ["class", "band"]).select("tile", "class")
        several = kept.groupBy("tile").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("tile")
        tiles = scratch.save(kept.join(several, "tile"), "tiles")
        scratch.drop("tiles", but_last=True)
    return tiles


def link_classes(docs: DataFrame, named: DataFrame, words: int, threshold: Fraction, scratch: Scratch) -> DataFrame:
    """(node, root): components of the classes that link with another class.  ``docs`` has doc_id and text, ``named`` doc_id, class and needs."""
    reps = named.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("needs").alias("needs"))
    tiles = _core(scratch.save(_tiles(docs.select("text"), words, threshold), "tiles"), reps, scratch)
    # a tile is led by the class that is in most tiles: the copy that the others have most in common with.  A class goes with the leaders it
    # shares most tiles with; whatever they leave apart is seen to in round 2
    weighed = tiles.join(tiles.groupBy("class").agg(F.count("*").alias("degree")), "class").select("tile", "class", "degree")
    leading = weighed.groupBy("tile").agg(F.max(F.struct("degree", "class"))["class"].alias("leader"))
    shared = tiles.join(leading, "tile").groupBy("class", "leader").agg((-F.count("*")).alias("fewer"))
    likest = F.slice(F.sort_array(F.collect_list(F.struct("fewer", "leader"))), 1, LEADERS)
    stars = shared.filter("class <> leader").groupBy("class").agg(likest.alias("likest")).select("class", F.explode("likest.leader").alias("leader"))
    leaders = _with_shares(scratch.save(stars, "stars"))
    # classes of the tiles without a leader but themselves are wanted for round 2
    members = tiles.select("class").distinct().join(leaders, "class", "left").withColumn("leaders", F.coalesce("leaders", F.expr("cast(array() as array<struct<leader: bigint, share: bigint>>)")))
    sets = scratch.save(_sets_of(scratch.save(reps.select("class", "doc_id").join(members, "class").select("doc_id", "class", "leaders"), "tile-classes"), docs, words), "tile-sets")
    scratch.drop("tile-classes", "stars")
    stars = scratch.save(_linked_with_leaders(sets, threshold), "star-links")
    first = components(stars, scratch, "stars")

    rooted = tiles.join(first.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_ = rooted.groupBy("tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    members = scratch.save(rooted.join(open_.select("tile", "n"), "tile"), "open-tiles")
    scratch.drop("tiles")
    few = scratch.save(_pairs_of_small(members.filter(F.col("n") <= PAIR_TILE), reps), "small-pairs")
    large = members.filter(F.col("n") > PAIR_TILE).withColumn("blocks", F.ceil(F.col("n") / BLOCK_CLASSES).cast("int"))
    compared = few.select(F.col("a").alias("class")).union(few.select("b")).union(large.select("class")).distinct()
    drawn = scratch.save(_bitmaps_of(sets.join(compared, "class", "left_semi")), "bitmaps")
    within = _within_bound(few.join(drawn.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a").join(drawn.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b"), threshold)
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = large.drop("n").withColumn("block", block).withColumn("other", others).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    dealt = dealt.join(drawn, "class").select("tile", "x", "y", "block", "class", "root", "n", "bits").repartition("tile", "x", "y").sortWithinPartitions("tile", "x", "y", "block", "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[tuple[int, int]] = set()  # pairs of this task; the same pair meets in many tiles

        def close() -> list[tuple[int, int]]:
            x, y = held[0][0][1:]
            split = sum(h[1] == x for h in held) if x != y else 0
            if len(held) < 2 or (x != y and split in (0, len(held))):
                return []
            pairs = set(tile_candidates(np.array([h[2] for h in held]), np.array([h[3] for h in held]), np.array([h[4] for h in held]), [h[5] for h in held], split, threshold)) - seen
            if len(seen) > SEEN_CLASSES:
                seen.clear()
            seen.update(pairs)
            return sorted(pairs)

        for batch in batches:
            out = []
            for tile, x, y, block, name, root, n, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = tile, x, y
                if held and held[0][0] != at:
                    out.extend(close())
                    held.clear()
                held.append((at, block, name, root, n, bits))
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], names=["a", "b"])
        if held:
            out = close()
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    pairs = scratch.save(dealt.mapInArrow(compare, "a long, b long").union(within).distinct(), "open-pairs")
    scratch.drop("open-tiles", "small-pairs", "bitmaps")
    if pairs.isEmpty():
        return first
    asked = _with_shares(pairs.select(F.col("b").alias("class"), F.col("a").alias("leader")))
    more = scratch.save(_linked_with_leaders(sets.select("class", "shingles").join(asked, "class"), threshold), "more-links")
    scratch.drop("tile-sets")
    return components(stars.union(more), scratch, "links")


def shingle_components(docs: DataFrame, *, words: int, threshold: Fraction, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, component_id, leader) for every row: the least doc_id that links reach, and whether this row's class is the one
    of its component to keep (the least id's least class)."""
    scratch = Scratch(docs.sparkSession, "shingle-join")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    named = scratch.save(with_class(docs, words, threshold).drop("text"), "classes")
    linked_ = link_classes(docs, named, words, threshold, scratch)
    classes = named.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(linked_.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "class")).alias("best"))  # an id before none
    found = rooted.join(best, "root").select("class", F.col("best.least").alias("component_id"), F.col("best.class").alias("best"))
    full = named.filter("class is not null").join(found, "class").select("doc_id", "n_shingles", "class", "component_id", ((F.col("class") == F.col("best")) & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("leader"))
    empty = named.filter("class is null").select("doc_id", "n_shingles", "class", F.col("doc_id").alias("component_id"), F.lit(True).alias("leader"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, *, words: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row of every component: the one with the least doc_id, and of equal rows with that id the first by all its columns as JSON.
    Rows without words all stay; all columns pass as they are.

    What goes is looked up, by broadcast up to BROADCAST_CLASSES rows and by a shuffle beyond; texts move only then, or where equal rows share an id."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    found = scratch.save(shingle_components(docs, words=words, threshold=threshold).filter("class is not null").select(F.col("doc_id").alias("_id"), F.col("class").alias("_class"), "leader"), "found")
    here = F.col("class").eqNullSafe(F.col("_class")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    goes = found.filter("not leader").select("_id", "_class").distinct()
    twice = found.filter("leader").groupBy("_id", "_class").count().filter("count > 1").select("_id", "_class")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df
    stays = with_class(packed(docs, "doc_id", "text"), words).join(few(goes), here, "left_anti")
    rows = [F.struct(*unpacked(docs.columns, "doc_id", "text")).alias("row")]
    if not twice.isEmpty():
        twice = few(twice)
        equal = stays.join(twice, here, "left_semi").select("class", *rows).groupBy("class").agg(F.min_by("row", F.to_json("row")).alias("row"))
        return stays.join(twice, here, "left_anti").select(*rows).unionByName(equal.select("row")).select("row.*")
    return stays.select(*rows).select("row.*")


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shingle_components(read_table(spark, sf_dir, "documents"), words=3, threshold=Fraction(9, 10))
    return found.select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_shingle_join": op10_shingle_join}
SQL = {
    "op10_shingle_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i+2], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b using (s) where a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(reach.b) component_id from reach left join n on n.doc_id = reach.a join documents d on d.doc_id = reach.a group by d.doc_id
"""
}
