"""A Merkle manifest of a dataset: every document's leaf, roots by group and of all, and a proof for every document.

Leaves are hashed where rows are read, so texts never move.  They are numbered within their group (``lang``) in order of doc_id by a range
partition whose parts are counted, and dealt into aligned blocks of 8 ** BLOCK_LEVELS leaves: a group that holds all rows is as many blocks as
it has leaves for.  A block's authentication paths come from a *fractal traversal*: the block's levels are cut into strata of
SUBTREE_LEVELS levels, and every stratum keeps one existing subtree (around the current leaf) and one desired subtree (the next one, which
takes in one leaf for each step, so that it is done when the traversal gets there).  Memory is that of two subtrees a stratum.  The levels
above the blocks are grouped and hashed by Spark, run by run; their siblings come down again by one join a level, and are appended.

Digests are 32 bytes here; ``H`` hashes their hexadecimal text.  A null group is a group of its own and comes first; groups and ids are
in ascending order, nulls first; rows of one id are ordered by their leaf (equal leaves can change places without any change).  Null
fields count as ``-``, an empty text as ``0:``.  An empty table has no root and gives no rows.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.llm.common import LOWER, UPPER, Scratch, held_out, read_table

FAN, BLOCK_LEVELS, SUBTREE_LEVELS, SIZE = 8, 4, 2, 32
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: list[Column]) -> Column:
    """The sha256 of all fields, each with the number of its bytes."""
    text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256))


def node(children: bytes) -> bytes:
    """H of the children, whose digests stand one after the other."""
    return hashlib.sha256(children.hex().encode()).digest()


def levels_of(n: int) -> int:
    """How often n nodes are gathered until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtree:
    """The levels ``base`` to ``base + height - 1`` over the leaves from ``first`` on, built leaf by leaf.

    Below ``base``, a level holds only its unfinished run; from ``base`` on it keeps its nodes."""

    def __init__(self, base: int, height: int, first: int, last: int):
        self.base, self.top, self.first, self.next, self.last = base, base + height, first, first, last
        self.kept = [bytearray() for _ in range(height)]
        self.open = [bytearray() for _ in range(base + height)]

    def take(self, leaves: bytes) -> None:
        """Take in the next leaf; with the last one, unfinished runs become nodes too."""
        if self.next >= self.last:
            return
        self._push(0, leaves[SIZE * self.next : SIZE * (self.next + 1)])
        self.next += 1
        if self.next == self.last:
            for level in range(self.top - 1):
                if run := self.open[level]:
                    self.open[level] = bytearray()
                    self._push(level + 1, node(run))

    def _push(self, level: int, digest: bytes) -> None:
        while True:
            if level >= self.base:
                self.kept[level - self.base] += digest
            if level == self.top - 1:
                return
            run = self.open[level]
            run += digest
            if len(run) < FAN * SIZE:
                return
            digest, self.open[level] = node(run), bytearray()
            level += 1

    def siblings(self, level: int, leaf: int) -> tuple[int, int, bytes]:
        """The leaf's place in its run at this level, the run's size, and the others of the run."""
        at = leaf // FAN**level - self.first // FAN**level
        run = self.kept[level - self.base][at // FAN * FAN * SIZE : (at // FAN + 1) * FAN * SIZE]
        place = at % FAN
        return place, len(run) // SIZE, bytes(run[: place * SIZE] + run[(place + 1) * SIZE :])


def traversal(leaves: bytes, levels: int, height: int = SUBTREE_LEVELS) -> Iterator[list[tuple[int, int, bytes]]]:
    """The authentication path of every leaf in turn: for each level its place, the run's size and its siblings."""
    n = len(leaves) // SIZE
    strata = [(base, min(height, levels - base)) for base in range(0, levels, height)]
    spans = [FAN ** (base + own) for base, own in strata]

    def subtree(k: int, first: int) -> Subtree:
        return Subtree(*strata[k], first, min(first + spans[k], n))

    existing = [subtree(k, 0) for k in range(len(strata))]
    for tree in existing:
        while tree.next < tree.last:
            tree.take(leaves)
    desired = [subtree(k, spans[k]) for k in range(len(strata))]
    for leaf in range(n):
        for k, span in enumerate(spans):
            if leaf and leaf % span == 0:
                existing[k], desired[k] = desired[k], subtree(k, leaf + span)
        yield [existing[level // height].siblings(level, leaf) for level in range(levels)]
        for tree in desired:
            tree.take(leaves)


def root_of(leaves: bytes, levels: int) -> bytes:
    """The node over all leaves, ``levels`` above them."""
    for _ in range(levels):
        leaves = b"".join(node(leaves[k : k + FAN * SIZE]) for k in range(0, len(leaves), FAN * SIZE))
    return leaves


def numbered(rows: DataFrame, scratch: Scratch, name: str, group: str, *order: str) -> DataFrame:
    """``rows`` with ``at``, each one's place in its group, and ``n``, the group's size.

    Rows are range-partitioned by (group, order), equal ones by chance, and counted as they stream by; the counts of the parts before are added."""
    sort = [F.col(group), *[F.col(c) for c in order], F.xxhash64(F.monotonically_increasing_id())]
    dealt = rows.withColumn("_lot", sort[-1])
    sort[-1] = F.col("_lot")
    dealt = dealt.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *sort).sortWithinPartitions(*sort).drop("_lot")
    place = dealt.columns.index(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, own = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            found = []
            for value in batch.column(place).to_pylist():
                own = own + 1 if value == last else 0
                last = value
                found.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(found), pa.int64()), pa.array(found, pa.int64())], names=[*batch.schema.names, "_part", "_own"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema] + ["_part long", "_own long"])
    counted = scratch.save(dealt.mapInArrow(count, schema), name)
    sizes = counted.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy("_group")
    sizes = sizes.select("_group", "_of", (F.sum("_rows").over(whole.orderBy("_of")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    met = counted.join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_own")).alias("at"), "n")


def _blocks(leaves: DataFrame, block_levels: int) -> DataFrame:
    """One row a block of (lang, doc_id, leaf, claimed, at, n): the leaves' digests one after the other, and the node over them."""
    span = FAN**block_levels
    dealt = leaves.withColumn("block", F.floor(F.col("at") / span)).repartition("lang", "block").sortWithinPartitions("lang", "block", "at").select("lang", "block", "n", "doc_id", "leaf", "claimed")
    schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("leaves", pa.binary()), ("claimed", pa.binary()), ("digest", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, leaves, claimed = None, [], bytearray(), bytearray()

        def row() -> pa.RecordBatch:
            out = *key, ids, bytes(leaves), bytes(claimed), root_of(bytes(leaves), min(block_levels, levels_of(key[2])))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            for lang, block, n, doc_id, leaf, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, block, n) != key:
                    if ids:
                        yield row()
                    key, ids, leaves, claimed = (lang, block, n), [], bytearray(), bytearray()
                ids.append(doc_id)
                leaves += leaf
                claimed += other
        if ids:
            yield row()

    return dealt.mapInArrow(pack, "lang string, block long, n long, doc_ids array<bigint>, leaves binary, claimed binary, digest binary")


def _node(members: str) -> Column:
    """node() as a column."""
    return F.unhex(F.sha2(F.array_join(F.transform(members, lambda x: F.lower(F.hex(x))), ""), 256))


#: the type of a path above the blocks
_STEPS = "array<struct<place:int,members:array<binary>>>"


def climb(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """From (group, at, n, digest): the tops (group, digest) and, for each level, its runs (group, run, n, members)."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    tops, runs = nodes.filter("n = 1").select("group", "digest"), []
    while most > 1:
        members = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        level = nodes.filter("n > 1").groupBy("group", F.floor(F.col("at") / FAN).alias("run"), "n").agg(members.alias("members"))
        runs.append(scratch.save(level, f"{name}-runs"))
        nodes = runs[-1].select("group", F.col("run").alias("at"), F.ceil(F.col("n") / FAN).alias("n"), _node("members").alias("digest"))
        tops = tops.unionByName(nodes.filter("n = 1").select("group", "digest"))
        most = -(-most // FAN)
    return tops, runs


def descend(tops: DataFrame, runs: list[DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """(group, at, up) and the tops' other columns for every node at the lowest level; ``up`` is its path, after which its top's ``up`` follows.

    tops: (group, levels, up, ...).  One join a level, by (group, run); ``levels`` tells where a group's top stands."""
    more = [c for c in tops.columns if c not in ("group", "levels", "up")]
    start = lambda k: tops.filter(F.col("levels") == k).select("group", F.lit(0).cast("long").alias("at"), "up", *more)
    here = start(len(runs))
    for k in reversed(range(len(runs))):
        own = runs[k].select(F.col("group").alias("_g"), "run", "members")
        met = own.join(here, F.col("_g").eqNullSafe(F.col("group")) & (F.col("run") == F.col("at"))).select("group", "run", "members", F.posexplode("members").alias("_place", "_x"), "up", *more)
        step = F.array(F.struct(F.col("_place").cast("int").alias("place"), "members"))
        here = met.select("group", (F.col("run") * FAN + F.col("_place")).alias("at"), F.concat(step, "up").alias("up"), *more).unionByName(start(k))
        here = scratch.save(here, f"{name}-paths")
    return here


def _levels(n: Column, most: int) -> Column:
    """levels_of() as a column, for n up to ``most``."""
    out = F.lit(0)
    for k in range(levels_of(most)):
        out = out + (n > FAN**k).cast("int")
    return out


def proofs(leaves: DataFrame, scratch: Scratch | None = None, *, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """For every row of ``leaves`` (lang, doc_id, leaf, claimed): lang, doc_id, leaf, claimed, subroot, root, and its proof: ``places`` and
    ``widths`` (where it stands in the run of each level, and the run's size) and ``siblings``, all others of these runs from the lowest level on."""
    spark = leaves.sparkSession
    scratch = scratch or Scratch(spark, "merkle")
    leaves = scratch.save(leaves, "hashed")  # a range partition reads its rows twice
    blocks = scratch.save(_blocks(numbered(leaves, scratch, "leaves", "lang", "doc_id", "leaf"), block_levels), "blocks")
    scratch.drop("hashed", "leaves")
    span = FAN**block_levels
    nodes = blocks.select(F.col("lang").alias("group"), F.col("block").alias("at"), F.ceil(F.col("n") / span).alias("n"), "digest")
    tops, runs = climb(nodes, scratch, "blocks")
    sizes = nodes.filter("at = 0").select(F.col("group").alias("_g"), F.col("n").alias("_n"))
    tops = scratch.save(tops.join(sizes, F.col("group").eqNullSafe(F.col("_g"))).select(F.col("group").alias("lang"), F.col("digest").alias("subroot"), _levels(F.col("_n"), FAN ** len(runs)).alias("levels"), F.lit(0).alias("group")), "subroots")
    ordered = scratch.save(numbered(tops, scratch, "ordered", "group", "lang"), "numbered")
    top, over = climb(ordered.select("group", "at", "n", F.col("subroot").alias("digest")), scratch, "roots")
    start = top.select("group", F.lit(len(over)).alias("levels"), F.array().cast(_STEPS).alias("up"), F.col("digest").alias("root"))
    above = descend(start, over, scratch, "roots")
    met = ordered.select("lang", "subroot", "levels", F.col("at").alias("_at")).join(above, F.col("_at") == F.col("at")).select(F.col("lang").alias("group"), "levels", "up", "subroot", "root")
    paths = descend(scratch.save(met, "tops"), runs, scratch, "blocks").select(F.col("group").alias("_lang"), F.col("at").alias("_at"), "up", "subroot", "root")
    whole = blocks.join(paths, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("block") == F.col("_at"))).select("lang", "n", "doc_ids", "leaves", "claimed", "subroot", "root", "up")
    schema = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.binary()), ("claimed", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary()), ("places", pa.list_(pa.int32())), ("widths", pa.list_(pa.int32())), ("siblings", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang, n, ids, leaves, claimed, subroot, root, up = (c[k].as_py() for c in batch.columns)
                places, widths = [s["place"] for s in up], [len(s["members"]) for s in up]
                tail = b"".join(x for s in up for at, x in enumerate(s["members"]) if at != s["place"])
                held: list[tuple] = []
                for at, path in enumerate(traversal(leaves, min(block_levels, levels_of(n)))):
                    cut = slice(SIZE * at, SIZE * (at + 1))
                    held.append((lang, ids[at], leaves[cut], claimed[cut], subroot, root, [p[0] for p in path] + places, [p[1] for p in path] + widths, b"".join(p[2] for p in path) + tail))
                    if len(held) == 1024 or at + 1 == len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
                        held = []

    return whole.mapInArrow(emit, "lang string, doc_id long, leaf binary, claimed binary, subroot binary, root binary, places array<int>, widths array<int>, siblings binary")


def folded(digest: bytes, places: list[int], widths: list[int], siblings: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    text, at, mine = siblings.hex(), 0, digest.hex()
    for place, width in zip(places, widths, strict=True):
        middle, at_end = at + 2 * SIZE * place, at + 2 * SIZE * (width - 1)
        mine = hashlib.sha256((text[at:middle] + mine + text[middle:at_end]).encode()).hexdigest()
        at = at_end
    return bytes.fromhex(mine)


def verify(proved: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified (all digests as text), from rows of proofs(): the root is folded from ``claimed``."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, leaf, claimed, subroot, root, places, widths, siblings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = folded(claimed, places, widths, siblings)
                out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(siblings.hex().encode()).hexdigest(), found.hex(), found == root))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)

    rows = proved.select("doc_id", "leaf", "claimed", "subroot", "root", "places", "widths", "siblings")
    return rows.mapInArrow(check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(lang, doc_id, leaf, claimed): ``claimed`` is the leaf of the text with A-Z lower-cased where ``tampered``, else the leaf."""
    fields = [F.col(f"`{c}`") for c in FIELDS]
    leaf = leaf_digest(fields)
    claimed = leaf if tampered is None else F.when(tampered, leaf_digest([*fields[:-1], F.translate(fields[-1], UPPER, LOWER)]))
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), claimed.alias("claimed"))
    return rows.withColumn("claimed", F.coalesce("claimed", "leaf"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(proofs(leaves_of(read_table(spark, sf_dir, "documents"), held_out("doc_id", 3, 0))))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}


def _sql(levels: int = 8) -> str:
    """Up to 8 ** levels leaves a group, and groups."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join([*[field(c) for c in FIELDS[:-1]], field(text)]) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    with_ = [
        f"d as materialized (select doc_id, lang, {leaf('text')} leaf, {crc} % 3 = 0 tampered, {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} changed from documents)",
        "a0 as materialized (select coalesce(lang, '') || case when lang is null then '0' else '1' end g, lang, doc_id, row_number() over (partition by lang order by doc_id) - 1 spot, count(*) over (partition by lang) n, leaf d, case when tampered then changed else leaf end x, leaf from d)",
    ]

    def rise(t: str) -> None:
        for k in range(levels):
            with_.append(f"{t}r{k} as materialized (select g, spot // 8 run, n, list(d order by spot) m from {t}{k} where n > 1 group by 1, 2, 3)")
            with_.append(f"{t}{k + 1} as materialized (select g, run spot, (n + 7) // 8 n, sha256(array_to_string(m, '')) d from {t}r{k})")
        with_.append(f"{t}top as materialized (" + " union all ".join(f"select g, d from {t}{k} where n = 1" for k in range(levels + 1)) + ")")

    def fold(t: str, first: str, keep: str) -> str:
        last = first
        for k in range(levels):
            before, after = f"array_to_string(m[:(spot // {8**k}) % 8], '')", f"array_to_string(m[(spot // {8**k}) % 8 + 2:], '')"
            run = f"{t}r{k}"
            with_.append(f"{t}f{k} as materialized (select {keep}, l.g, l.spot, case when m is null then x else sha256({before} || x || {after}) end x, case when m is null then p else p || {before} || {after} end p from {last} l left join {run} r on r.g = l.g and r.run = l.spot // {8 ** (k + 1)})")
            last = f"{t}f{k}"
        return last

    rise("a")
    with_.append("b0 as materialized (select 0 g, row_number() over (order by right(g, 1), g) - 1 spot, count(*) over () n, d, g lang from atop)")
    rise("b")
    with_.append("s as (select *, '' p from a0)")
    low = fold("a", "s", "doc_id, leaf, l.lang")
    with_.append(f"t as (select doc_id, leaf, 0 g, b0.spot, x, p, b0.d subroot from {low} l join b0 on b0.lang = l.g)")
    high = fold("b", "t", "doc_id, leaf, subroot")
    return f"with {', '.join(with_)}\nselect doc_id, leaf, subroot, btop.d root, sha256(p) proof_sha256, x folded_root, x = btop.d verified from {high} cross join btop"


SQL = {"op12_merkle_manifest": _sql()}
