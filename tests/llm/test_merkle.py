"""The Merkle manifest against a recursion over lists."""

import hashlib
import zlib

import pytest

from echotrace.llm import merkle
from echotrace.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at long, root string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """The top and each leaf's siblings and way up, by definition."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for k, a in enumerate(at):
            run = level[a // 8 * 8 : a // 8 * 8 + 8]
            paths[k].append((run[: a % 8], run[a % 8 + 1 :]))
        level, at = [H("".join(level[k : k + 8])) for k in range(0, len(level), 8)], [a // 8 for a in at]
    return level[0], paths


def expected(rows):
    out, groups = [], {}
    for row in sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(*r[:5]))):
        groups.setdefault(row[2], []).append(row)
    own = {lang: tree([leaf(*r[:5]) for r in members]) for lang, members in groups.items()}
    root, above = tree([own[lang][0] for lang in groups])
    for (lang, members), up in zip(groups.items(), above, strict=True):
        subroot, paths = own[lang]
        for row, path in zip(members, paths, strict=True):
            doc_id, text, *rest = row[:5]
            mine = leaf(*row[:5])
            changed = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 0
            claim = leaf(doc_id, "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None, *rest) if changed else mine
            digest = claim
            for before, after in [*path, *up]:
                digest = H("".join([*before, digest, *after]))
            proof = H("".join(x for before, after in [*path, *up] for x in [*before, *after]))
            out.append((doc_id, mine, subroot, root, proof, digest, digest == root))
    return sorted(out, key=str)


def rows_of(n):
    langs = ["en", "en", "en", None, "fr", "Zé", "é"]
    return [(k, f"Text {k} É" if k % 5 else None, langs[k % 7] if k else "lone", None if k % 3 else "s", len(str(k)), k, "x") for k in range(n)]


@pytest.mark.parametrize("n,block_levels", [(1, 1), (60, 1), (700, 2), (120, 4)])
def test_manifest_equals_a_recursion(spark, n, block_levels):
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = merkle.verify(merkle.proofs(merkle.leaves_of(docs, held_out("doc_id", 3, 0)), block_levels=block_levels)).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, "A", None, None, None, 0, ""), (None, "A", None, None, None, 0, ""), (7, "", "en", "s", 0, 0, ""), (7, "", "en", "s", 0, 0, ""), (7, "B", "en", "s", 1, 0, ""), (8, "Zoë 😀 " * 9000, "en", None, 1, 0, "")]
    found = merkle.verify(merkle.proofs(merkle.leaves_of(spark.createDataFrame(rows, SCHEMA), held_out("doc_id", 3, 0)))).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.verify(merkle.proofs(merkle.leaves_of(none))).collect() == []


def test_many_groups(spark):
    rows = [(k, "t", f"lang{k:03d}" if k % 2 else "lang000", "s", 1, 0, "") for k in range(150)]
    found = merkle.verify(merkle.proofs(merkle.leaves_of(spark.createDataFrame(rows, SCHEMA)), block_levels=1)).collect()
    mine = {r[0]: r for r in expected([(*r[:1], r[1], *r[2:]) for r in rows])}
    assert {r.doc_id: (r.root, r.proof_sha256, r.verified) for r in found} == {k: (r[3], r[4], True) for k, r in mine.items()}


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 200, 513])
@pytest.mark.parametrize("height", [1, 2, 3])
def test_traversal_holds_little_and_equals_whole_levels(n, height):
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    levels = merkle.levels_of(n)
    _, paths = tree([d.hex() for d in digests])
    got = list(merkle.traversal(b"".join(digests), levels, height))
    assert [[p[2].hex() for p in path] for path in got] == [["".join(a + b) for a, b in path] for path in paths]
    held = merkle.Subtree(0, 1, 0, n)
    for _ in range(n):
        held.take(b"".join(digests))
    assert len(held.open[0]) < 8 * 32


def test_a_changed_proof_or_leaf_fails(spark):
    docs = spark.createDataFrame(rows_of(100), SCHEMA)
    first = merkle.proofs(merkle.leaves_of(docs)).filter("doc_id = 5").first()
    good = first.leaf, first.places, first.widths, first.siblings
    assert merkle.folded(*map(lambda x: bytes(x) if isinstance(x, bytearray) else x, good)) == bytes(first.root)
    bad = bytes(64 * [0])[:32] + bytes(first.siblings)[32:]
    assert merkle.folded(bytes(first.leaf), first.places, first.widths, bad) != bytes(first.root)
