"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.llm import hard_negatives as mining
from echotrace.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score double, query long"


def whole(v):
    return [math.floor(256 * x) for x in v]


def score(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute(rows):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by all pairs of whole numbers."""
    kept = []
    for key, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or sum(x * x for x in whole(v)) >= 2**63:
            continue
        kept.append((key, whole(v), label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, (key, v, label) in enumerate(kept):
        if key is None or key % 100:
            continue
        positives = sorted(((score(v, w), other) for j, (other, w, own) in enumerate(kept) if j != k and own == label), key=order)[:5]
        for best, positive in positives:
            hard = sorted(((score(v, w), other) for other, w, own in kept if own != label and 80 * best <= 100 * score(v, w) <= 100 * best), key=order)[:5]
            out += [(key, positive, n + 1, other, best, s) for n, (s, other) in enumerate(hard)]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    scratch = Scratch(spark, "test-mining")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = mining.build_index(mining.whole_vectors(docs, key="vec_id", vector="embedding", label=F.col("label")), scratch)
    return sorted(map(tuple, mining.mine(index, scratch, **how).collect()), key=str)


def drawn(n, d, labels=4, seed=0, scale=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, d))
    x = (centres[draw.integers(0, 12, n)] + 0.4 * draw.normal(size=(n, d))) / math.sqrt(d) * scale
    return [(k * 10, x[k].tolist(), int(draw.integers(0, labels)), "r", 0.5, 1) for k in range(n)]


@pytest.mark.parametrize("how", [{}, {"slice_bytes": 700}, {"opening": 1}, {"opening": 10**9}])
def test_equals_all_pairs(spark, how):
    rows = drawn(900, 7)
    assert mined(spark, rows, **how) == brute(rows)


def test_odd_rows_and_ties(spark):
    rows = drawn(60, 4)
    same = [(k, [0.5, 0.5, -0.25, 0.0], k % 3, "r", 0.5, 1) for k in range(100, 140)]
    odd = [(200, None, 1, "", 0.0, 0), (200, [1.0, 2.0], 1, "", 0.0, 0), (200, [1.0, 2.0], 1, "", 0.0, 0), (200, [float("nan")], 1, "", 0.0, 0), (300, [], 1, "", 0.0, 0), (300, [1.0, None], 1, "", 0.0, 0), (400, [1.0], None, "", 0.0, 0), (None, [0.5, 0.5, 0.5], 1, "", 0.0, 0), (500, [float("inf")], 1, "", 0.0, 0), (600, [-1.0, -1.0], 2, "", 0.0, 0), (700, [1e300], 1, "", 0.0, 0)]
    rows = [*rows, *same, *odd]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, odd[:1]) == []


@pytest.mark.parametrize("scale", [2.0**-9, 2.0**9, 2.0**21])
def test_scores_are_exact_at_any_size(spark, scale):
    rows = drawn(150, 5, scale=scale)
    assert mined(spark, rows) == brute(rows)


def test_bounds_hold_and_leave_few(spark):
    draw = np.random.default_rng(1)
    x = np.floor(256 * draw.normal(size=(4000, 64)) / 8)
    book = mining.Codebook.fit(x[:1500], 64)
    codes, reach = book.encode(x)
    anchors = x[:40]
    tables = book.tables(anchors)
    told = sum(tables[:, m][:, codes[:, m]].astype(float) for m in range(tables.shape[1]))
    exact = anchors @ x.T
    off = np.sqrt((anchors**2).sum(1))[:, None] * reach
    assert (np.abs(told - exact) <= off).all()
    # what bounds leave of the rows for the five best (nothing alike: the worst case), other anchors' rows included
    low = np.sort(told - off, axis=1)[:, -6]
    assert ((told + off) >= low[:, None]).mean() < 0.15
