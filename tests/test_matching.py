"""Matchers within a retention and against stored rows, by all pairs; what they compare, and how that grows."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.functions.similarity import FRAMES
from echotrace.operators import cells, forwards, repeats, similar, video
from echotrace.streaming.matches import stream_matches

START = dt.datetime(2024, 1, 1)
HOUR = 3600
SCHEMA = (
    "id long, g string, ts timestamp, who string, forward_id string, forward_hash string, forward_text_hash string, v array<double>, h binary, "
    "videos array<struct<sha256:string,frame_hashes:array<string>,duration_ms:bigint,metadata_hash:string,analysis:string>>"
)


def drawn(n, seed=0, hours=400):
    draw = random.Random(seed)
    films = [[f"{draw.getrandbits(256):064x}" for _ in range(FRAMES)] for _ in range(6)]
    for film in films:
        film[0] = "0" * 64  # all begin black
    rows = []
    for k in range(n):
        frames = [f"{int(x, 16) ^ sum(1 << draw.randrange(256) for _ in range(draw.choice([0, 0, 20, 36]))):064x}" for x in draw.choice(films)]
        frames[0] = "0" * 64
        clip = (draw.choice([None, "a", "b"]), draw.choice([frames, []]), draw.choice([10000, 10200, 14000]), draw.choice([None, "m", "n"]), draw.choice(["perceptual", "metadata"]))
        bits = draw.getrandbits(3) * 0x1111 ^ (1 << draw.randrange(16))
        rows.append((
            k, draw.choice(["g", "g", None]), START + dt.timedelta(hours=draw.randrange(hours)), draw.choice(["a", "b", "c", "d", "", None]), draw.choice(["x", "y", "z", "", None]), draw.choice(["p", "q", None, f"u{k}"]), draw.choice([None, "", "t"]),
            draw.choice([None, [], [1.0], [draw.choice([-1.0, 0.5, 1.0]), draw.choice([0.0, 0.5, 1.0])]]), draw.choice([None, bits.to_bytes(2, "big"), bits.to_bytes(2, "big")]), draw.choice([None, [clip], [clip, (None, [], 0, "m", "metadata")]]),
        ))
    return rows


def earlier(rows, r, retention, inclusive):
    """Rows of its group before ``r`` (at it too), in order, less than the retention older."""
    key = (r[2], r[0])
    own = [o for o in rows if o[1] == r[1] and ((o[2], o[0]) < key or (inclusive and o[0] == r[0])) and (retention is None or o[2] > r[2] - dt.timedelta(seconds=retention))]
    return sorted(own, key=lambda o: (o[2], o[0]))


def some(x):
    return x is not None and x != ""


def cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    dot, n = sum(x * y for x, y in zip(a, b)), (sum(x * x for x in a) ** 0.5) * (sum(y * y for y in b) ** 0.5)
    return round(dot / (n + 1e-9), 9)


def alike(a, b):
    return 0.0 if a is None or b is None or len(a) != len(b) else 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / (8 * len(a))


def tier(current, stored):
    """The tier of two messages' videos, or None."""
    out = []
    for x in current or []:
        for y in stored or []:
            if x[0] and x[0] == y[0]:
                out.append(0)
            if len(x[1]) == len(y[1]) == FRAMES and abs(x[2] - y[2]) <= max(1000, int(max(x[2], y[2]) * 0.03)):
                each = [1 - (int(p, 16) ^ int(q, 16)).bit_count() / 256 for p, q in zip(x[1], y[1])]
                if sum(each) / FRAMES >= 0.9 and sum(e >= 0.85 for e in each) >= 4:
                    out.append(1)
            if x[4] == "metadata" and x[3] and x[3] == y[3]:
                out.append(2)
    return min(out) if out else None


def by_keys(rows, now, retention):
    match, who = {}, {}
    for r in now:
        share = lambda o: [k for k in range(3) if some(r[4 + k]) and r[4 + k] == o[4 + k]]  # noqa: B023, E731
        first = next((o for o in earlier(rows, r, retention, False) if share(o)), None)
        if first:
            match[r[0]] = (first[0], forwards.KEYS[share(first)[0]])
        who[r[0]] = len({o[3] for o in earlier(rows, r, retention, True) if share(o) and some(o[3])})
    return match, who


def by_score(rows, now, retention, score, at, threshold):
    match, who = {}, {}
    for r in now:
        best = max(((score(r[at], o[at]), -n, o[0]) for n, o in enumerate(earlier(rows, r, retention, False))), default=(0, 0, 0))
        if best[0] > 0:
            match[r[0]] = (best[2], best[0])
        who[r[0]] = len({o[3] for o in earlier(rows, r, retention, True) if score(r[at], o[at]) >= threshold and some(o[3])})
    return match, who


def by_video(rows, now, retention):
    match, who = {}, {}
    for r in now:
        hits = [(tier(r[9], o[9]), n, o[0]) for n, o in enumerate(earlier(rows, r, retention, False)) if tier(r[9], o[9]) is not None]
        if hits:
            match[r[0]] = (min(hits)[2], video.TIERS[min(hits)[0]])
        who[r[0]] = len({o[3] for o in earlier(rows, r, retention, True) if tier(r[9], o[9]) is not None and some(o[3])})
    return match, who


KINDS = {
    "keys": (by_keys, lambda m, h, o: forwards.forward_matches(m, h, group="g", order="id", **o), lambda m, h, o: forwards.senders_by_forward(m, h, group="g", order="id", sender="who", **o)),
    "vectors": (lambda *a: by_score(*a, cosine, 7, 0.9), lambda m, h, o: similar.best_cosine(m, h, group="g", order="id", vector="v", threshold=0.9, size=20, **o), lambda m, h, o: similar.senders_by_cosine(m, h, group="g", order="id", vector="v", sender="who", threshold=0.9, size=20, **o)),
    "hashes": (lambda *a: by_score(*a, alike, 8, 0.8), lambda m, h, o: similar.best_hash(m, h, group="g", order="id", bits="h", threshold=0.8, size=20, **o), lambda m, h, o: similar.senders_by_hash(m, h, group="g", order="id", bits="h", sender="who", threshold=0.8, size=20, **o)),
    "videos": (by_video, lambda m, h, o: video.video_matches(m, h, group="g", order="id", **o), lambda m, h, o: video.senders_by_video(m, h, group="g", order="id", sender="who", **o)),
}


def split(spark, rows, retention):
    """All rows at once without a retention; else the later half against the earlier one."""
    cut = START + dt.timedelta(hours=200)
    now = rows if retention is None else [r for r in rows if r[2] >= cut]
    return now, spark.createDataFrame(now, SCHEMA), None if retention is None else spark.createDataFrame([r for r in rows if r[2] < cut], SCHEMA)


@pytest.mark.parametrize("retention", [None, 30 * HOUR])
@pytest.mark.parametrize("kind", KINDS)
def test_matcher_equals_all_pairs(spark, kind, retention):
    rows = drawn(150, seed=len(kind))
    brute, match, senders = KINDS[kind]
    options = {"ts": "ts", "retention_s": retention}
    now, a, history = split(spark, rows, retention)
    want_match, want_who = brute(rows, now, retention)
    assert {r[0]: (r[1], r[2]) for r in match(a, history, options).collect()} == want_match
    assert {r[0]: r[1] for r in senders(a, history, options).collect()} == want_who


@pytest.mark.parametrize("kind", KINDS)
def test_stream_equals_batch(spark, kind, tmp_path):
    rows = sorted(drawn(120, seed=7), key=lambda r: r[2])
    _, match, _ = KINDS[kind]
    options = {"ts": "ts", "retention_s": 60 * HOUR}
    source = f"{tmp_path}/in"
    for k in (0, 60):
        spark.createDataFrame(rows[k : k + 60], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream_matches(stream, lambda now, old: match(now, old, options), f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/checkpoint", ts="ts", retention_s=60 * HOUR).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, match(spark.createDataFrame(rows, SCHEMA), None, options).select(*got.columns).collect()))


@pytest.mark.parametrize("retention", [None, 30 * HOUR])
def test_cells_leave_nothing_out(spark, retention, monkeypatch):
    monkeypatch.setattr(cells, "ROWS_A_PIVOT", 9)
    rows = drawn(150, seed=11)
    now, a, history = split(spark, rows, retention)
    match, who = by_score(rows, now, retention, cosine, 7, 0.9)
    options = {"group": "g", "order": "id", "vector": "v", "threshold": 0.9, "size": 20, "ts": "ts", "retention_s": retention}
    assert {r[0]: (r[1], r[2]) for r in cells.matches_by_cosine(a, history, **options).collect()} == {k: v for k, v in match.items() if v[1] >= 0.9}
    assert {r[0]: r[1] for r in cells.senders_by_cosine(a, history, sender="who", **options).collect()} == who


def test_cells_compare_a_tenth_of_clustered_vectors(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 24))
    x = centres[draw.integers(0, 40, 4000)] + 0.15 * draw.normal(size=(4000, 24))
    table = spark.createDataFrame([(k, v.tolist(), str(k % 7)) for k, v in enumerate(x)], "id long, v array<double>, who string")
    asks, answers = cells.in_cells(similar._vectors(table, None, None, "id", None, "v"), 0.9, pivots=128)
    assert cells.comparisons(*cells.meeting(asks, answers, window=None, size=500)) < 4000 * 4000 / 10
    whole = similar.best_cosine(table, order="id", vector="v", threshold=0.9).filter("matched").drop("matched")
    assert sorted(map(tuple, cells.matches_by_cosine(table, order="id", vector="v", threshold=0.9).collect())) == sorted(map(tuple, whole.collect()))


def _pairs(spark, days, stored=0):
    """How many pairs of blocks rows of so many days make, and how many of two stored blocks."""
    rows = spark.range(days * 100).select(F.lit("g").alias("_g"), (F.col("id") * (864 * repeats.SECOND)).alias("_at"), F.col("id").alias("_id"), (F.col("id") >= stored).alias("_now"))
    met = similar.blocks_that_meet(rows, "_id", size=10, window=2 * repeats.DAY * repeats.SECOND)
    return met.select("_x", "_y").distinct().count(), met.filter("_x like '%/false/%' and _y like '%/false/%'").count()


def test_block_pairs_grow_with_the_window(spark):
    (a, _), (b, _) = _pairs(spark, 20), _pairs(spark, 80)
    assert 3.5 * a < b < 5 * a  # of four times the rows; all pairs would be sixteen times as many


def test_stored_rows_never_meet(spark):
    pairs, stored = _pairs(spark, 40, stored=3900)
    assert stored == 0 and pairs < _pairs(spark, 40)[0] / 8


def _took(work):
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


def test_senders_of_a_hot_key_grow_with_its_rows(spark):
    def count(n):
        rows = spark.range(n).select(F.col("id"), F.lit("g").alias("g"), F.lit("k").alias("k"), (F.col("id") % (n // 2)).cast("string").alias("who"))
        got = repeats.senders_by_any_key(rows, group="g", keys=["k"], order="id", sender="who").agg(F.sum("unique_senders")).first()[0]
        assert got == sum(min(k + 1, n // 2) for k in range(n))

    count(1000)
    small, large = _took(lambda: count(4000)), _took(lambda: count(8000))
    assert large < 2 * small + 2


def test_a_frame_that_all_share_makes_no_pairs(spark):
    def links(n):
        frame = lambda k: F.sha2(F.concat_ws("-", "id", F.lit(k)), 256)
        clip = F.struct(F.lit(None).cast("string").alias("sha256"), F.array(F.lit("0" * 64), *[frame(k) for k in range(4)]).alias("frame_hashes"), F.lit(10000).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("metadata_hash"), F.lit("perceptual").alias("analysis"))
        each = video._each(spark.range(n).select("id", F.lit("g").alias("g"), F.array(clip).alias("videos")), None, "g", "id", "videos", None, None)
        assert video.frame_links(each).count() == n

    links(100)
    assert _took(lambda: links(3000)) < 60
