"""Packing against the tokenizer, brute force and bounds."""

import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echotrace.llm import packing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, length long, ids string, sequence_id long"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check(found, texts, tokenizer, longest=2048):
    """Every piece once with the tokenizer's ids, gapless sequences of at most ``longest``; returns their number."""
    expected = []
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % longest + 1, len(ids) + 1, longest)]
        expected += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found))) == sorted(map(str, expected))
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= longest
    return len(sequences)


def test_query_equals_the_tokenizer(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = packing.op13_best_fit_packing(spark, SF).collect()
    total = sum(r.length for r in found)
    assert check(found, docs, tokenizer) <= -(-total // 2048) + 2


def test_odd_rows(spark, path, tokenizer):
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 9000), (3, "x<|endoftext|>y"), (4, "Zoë 😀  don't\n\n"), (4, "Zoë 😀  don't\n\n"), (5, " \t ")]
    docs = spark.createDataFrame([(*r, 1, "x", 7) for r in rows], SCHEMA)
    check(packing.unpack(packing.pack(docs, path)).collect(), rows, tokenizer)
    check(packing.unpack(packing.pack(docs, path, longest=7)).collect(), rows, tokenizer, 7)
    assert packing.unpack(packing.pack(spark.createDataFrame([], SCHEMA), path)).collect() == []


def test_one_length_for_all(spark, path, tokenizer):
    rows = [(k, "the cat sat") for k in range(3000)]
    found = packing.unpack(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path)).collect()
    assert check(found, rows, tokenizer) == -(-3000 // (2048 // 4))


def test_pieces_are_those_of_the_tokenizer(path, tokenizer):
    draw = random.Random(3)
    signs = " \n\t'aé×1.!<|日　\xa0sZ\x1c_"
    texts = ["", "don't 's ''s\n't", "a  b \n\n c ", "x  <|endoftext|> y", *("".join(draw.choice(signs) for _ in range(draw.randint(0, 30))) for _ in range(3000))]
    ids, at = packing.ByteEncoder(path)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("lengths", [[*range(1, 12)], [1, 2, 3, 5, 6, 9, 10, 11], [6, 7, 11], [4], []])
def test_patterns_leave_no_room(lengths):
    found = sorted(tuple(x for x in p if x) for p in packing.patterns_of(np.array(lengths, int), 12).tolist())
    every = [c[::-1] for n in (2, 3) for c in combinations_with_replacement(lengths, n) if sum(c) <= 12]
    # the last one is the longest that fits beside the first two, and nothing fits beside pairs
    assert found == sorted(c for c in every if max([x for x in lengths if x <= 12 - c[0] - c[1]], default=0) == (c[2] if len(c) == 3 else 0))


def test_fit_is_the_least_squares_solution_where_repeats_are_known():
    counts = np.zeros(13, np.int64)
    for times, pattern in ((40, (2, 10)), (30, (3, 9)), (20, (5, 7)), (7, (1, 1, 10))):
        for n in pattern:
            counts[n] += times
    patterns = packing.patterns_of(np.flatnonzero(counts), 12)
    active, x = packing.fit(counts, patterns)
    made = np.zeros(13)
    for k, n in zip(active, x):
        for length in patterns[k]:
            made[length] += n
    assert (x >= 0).all() and np.abs(made[1:] - counts[1:]).max() < 0.5
    assert sum(g[0] for g in packing.plan(counts, 12)) == 97


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=21, max_size=21))
def test_plan_holds_all_and_no_sequence_is_too_long(counts):
    counts = np.array([0, *counts[1:]])
    groups = packing.plan(counts, 20)
    used = np.zeros(21, np.int64)
    for repeats, held in groups:
        assert sum(a * b for a, b in held) <= 20
        for length, times in held:
            used[length] += repeats * times
    assert (used == counts).all()
    items = np.repeat(np.arange(21), counts)[::-1]
    rooms = []  # first fit, longest first
    for n in items:
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(20 - n)
        else:
            rooms[k] -= n
    assert sum(g[0] for g in groups) <= len(rooms) + 1
    ranks = {}
    for length, first, last, *_ in packing.ranges(groups):
        assert first == ranks.get(length, 0)
        ranks[length] = last
    assert all(ranks.get(n, 0) == counts[n] for n in range(1, 21))
