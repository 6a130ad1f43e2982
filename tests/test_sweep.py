"""Hot and plain keys, sets of senders, and blocks of asks against streams of answers: the same as all pairs, and no pair leaves a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_matching import HOUR, KINDS, alike, by_score, drawn, split

from echotrace.functions.similarity import FRAMES
from echotrace.operators import cells, repeats, similar, sliding, sweep, video

CLIP = "id long, g string, who string, videos array<struct<sha256:string,frame_hashes:array<string>,duration_ms:bigint,metadata_hash:string,analysis:string>>"


def copies(n):
    """Videos whose frames all differ in a digit, but match."""
    return [(k, "g", str(k % 50), [(None, [f"{(k + 1) * 16**f:064x}" for f in range(FRAMES)], 10000, None, "perceptual")]) for k in range(n)]


@pytest.mark.parametrize("retention", [None, 30 * HOUR])
@pytest.mark.parametrize("kind", ["keys", "videos"])
def test_hot_keys_equal_all_pairs(spark, kind, retention, monkeypatch):
    monkeypatch.setattr(sliding, "HOT", 4)
    rows = drawn(150, seed=21)
    brute, match, senders = KINDS[kind]
    options = {"ts": "ts", "retention_s": retention}
    now, a, history = split(spark, rows, retention)
    want_match, want_who = brute(rows, now, retention)
    assert {r[0]: (r[1], r[2]) for r in match(a, history, options).collect()} == want_match
    assert {r[0]: r[1] for r in senders(a, history, options).collect()} == want_who


def test_rows_of_keys_that_are_not_hot_go_to_one_place_each(spark):
    rows = spark.range(3000).select(F.lit("g").alias("_g"), F.lit(0).alias("_kind"), (F.col("id") % 600).cast("string").alias("_key"), F.col("id").alias("_at"), F.col("id").alias("_id"), F.lit(True).alias("_asks"), F.lit(True).alias("_answers"), F.lit(False).alias("_alone"), F.lit(1).alias("_code"))
    assert sliding._events(rows, None, False).count() == 3000
    assert sliding._events(rows, 700, True).count() == 3000


def test_sets_of_senders():
    few, many = {3, 90_000}, set(range(5000))
    for codes in (few, many, {7}, set()):
        bits = sum(1 << c for c in codes)
        assert sliding.united([sliding.packed(codes)]) == sliding.united([sliding.packed(bits)]) == len(codes)
        assert sliding.united([sliding.packed(codes), sliding.packed(few)]) == len(codes | few)
    assert len(sliding.packed(few)) < 12 and len(sliding.packed(many)) < 700


def test_near_videos_leave_a_row_each(spark):
    def near(n, senders):
        each = video._each(spark.createDataFrame(copies(n), CLIP), None, "g", "id", "videos", None, "who")
        return video._near(each, threshold=0.9, window=None, senders=senders)

    assert near(300, False).count() == 299 and near(300, True).count() == 299  # of 44,850 pairs
    found = {r["_id"]: r["first_id"] for r in near(300, False).collect()}
    assert found == dict.fromkeys(range(1, 300), 0)


@pytest.mark.parametrize("most", [8, 1 << 22])
def test_senders_of_near_videos(spark, most):
    each = video._each(spark.createDataFrame(copies(120), CLIP), None, "g", "id", "videos", None, "who")
    got = sliding.sender_counts(video._near(each, threshold=0.9, window=None, senders=True, size=16, most=most), "id")
    assert {r[0]: r[1] for r in got.collect()} == {k: min(k, 50) for k in range(1, 120)}


def test_frames_of_other_lengths(spark):
    short, odd, no = ["ab" * 8] * FRAMES, ["abc"] * FRAMES, ["zz" * 32] * FRAMES
    shapes = [short, [*short[:4], "ab" * 7 + "aa"], odd, odd, no, no, [""] * FRAMES, [""] * FRAMES, [*short[:4], None]]
    rows = [(k, "g", str(k), [(None, f, 10000, None, "perceptual")]) for k, f in enumerate(shapes)]
    messages = spark.createDataFrame(rows, CLIP)
    assert {r[0]: r[1] for r in video.video_matches(messages, group="g", order="id").collect()} == {1: 0, 3: 2}


def test_one_key_sends_a_count(spark):
    rows = spark.createDataFrame([(k, "g", str(k % 3), "k") for k in range(9)], "id long, g string, who string, k string")
    got = repeats.senders_by_any_key(rows, group="g", keys=["k"], order="id", sender="who")
    assert {r[0]: r[1] for r in got.collect()} == {k: min(k + 1, 3) for k in range(9)}


def test_asks_go_to_one_block_each_where_all_cells_reach_all(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROWS_A_PIVOT", 9)
    draw = np.random.default_rng(5)
    table = spark.createDataFrame([(k, v.tolist(), str(k % 7)) for k, v in enumerate(draw.normal(size=(900, 32)))], "id long, v array<double>, who string")
    left, right = cells.meeting(*cells.in_cells(similar._vectors(table, None, None, "id", None, "v"), 0.3), window=None, size=300)
    assert left.count() == 900 and left.select("_part").distinct().count() == 3
    assert right.count() <= 3 * 900  # not as often as there are cells
    whole = similar.best_cosine(table, order="id", vector="v", threshold=0.3).filter("matched").drop("matched")
    assert sorted(map(tuple, cells.matches_by_cosine(table, order="id", vector="v", threshold=0.3, size=300).collect())) == sorted(map(tuple, whole.collect()))
    mine, theirs = ({r[0]: r[1] for r in of(table, order="id", vector="v", sender="who", threshold=0.3, size=300).collect()} for of in (cells.senders_by_cosine, similar.senders_by_cosine))
    assert mine == theirs and max(mine.values()) == 7


@pytest.mark.parametrize("retention", [None, 30 * HOUR])
def test_hashes_that_repeat_are_compared_as_values(spark, retention, monkeypatch):
    rows = drawn(300, seed=31)
    now, a, history = split(spark, rows, retention)
    options = {"group": "g", "order": "id", "bits": "h", "threshold": 0.8, "ts": "ts", "retention_s": retention}
    monkeypatch.setattr(similar, "REPEATED", 1)
    monkeypatch.setattr(similar, "LINKED", 100)
    monkeypatch.setattr(similar, "block_pairs", None)  # no rows are compared
    match, who = by_score(rows, now, retention, alike, 8, 0.8)
    assert {r[0]: (r[1], r[2]) for r in similar.matches_by_hash(a, history, **options).collect()} == {k: v for k, v in match.items() if v[1] >= 0.8}
    assert {r[0]: r[1] for r in similar.senders_by_hash(a, history, sender="who", **options).collect()} == who


def test_senders_of_vectors_leave_a_row_an_ask(spark):
    """Equal vectors of many senders, some without one, in one group and block of time."""
    rows = spark.range(3000).select("id", F.lit("g").alias("g"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("v"), F.when(F.col("id") % 7 > 0, (F.col("id") % 1000).cast("string")).alias("who"))
    asks = similar._vectors(rows, None, "g", "id", None, "v", "who")
    left, right = sweep.dealt(asks, window=None, size=500)
    work = sweep.swept(left, right.filter("_0 <> ''"), lambda t: similar._Senders(t, None, 9, 0.99, False), "id long, n long", order=["_0"])
    assert work.count() == 3000
    got = {r[0]: r[1] for r in similar.senders_by_cosine(rows, group="g", order="id", vector="v", sender="who", threshold=0.99).collect()}
    assert all(got[k] == len({x % 1000 for x in range(k + 1) if x % 7 and x % 3 == k % 3}) for k in (0, 1, 2, 50, 999, 1000, 2047, 2999))
