"""Keyed state against the batch, across restarts, and what it holds."""

import datetime as dt
import random

from pyspark.sql import functions as F

from echotrace.operators import repeats
from echotrace.streaming import state

SCHEMA = "id long, g string, content string, who string, ts timestamp"
START = dt.datetime(2024, 1, 1)
HOUR = 3600


def drawn(n, hours):
    draw = random.Random(5)
    times = sorted(START + dt.timedelta(seconds=draw.randrange(hours * HOUR)) for _ in range(n))
    return [(k, draw.choice("gh"), draw.choice(["x", "x", "y", f"u{k % 7}"]), draw.choice(["a", "b", "c", "d", None]), t) for k, t in enumerate(times)]


def test_state_equals_the_batch_after_restarts(spark, tmp_path):
    rows = drawn(240, 200)
    options = {"key": ["g", "content"], "order": "id", "ts": "ts", "sender": "who", "retention_s": 20 * HOUR, "min_senders": 2, "cooldown_s": HOUR}
    for k in range(0, 240, 80):
        spark.createDataFrame(rows[k : k + 80], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        state.start(state.keyed_verdicts(stream, **options), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = {r["id"]: tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["id"]: tuple(r) for r in repeats.repeat_verdicts(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert got == want and len({r[3] for r in want.values()}) >= 4
    held = lambda name: spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", name).load()
    # no key is left whose last message the watermark has passed by the retention
    newest = max(r[4] for r in rows[:160])
    alive = {(r[1], r[2]) for r in rows if r[4] > newest - dt.timedelta(hours=21)}
    ends = held("ends").select("key.*").collect()
    assert ends and {tuple(r) for r in ends} <= alive
    senders = held("senders").select("key", "user_map_key").collect()
    assert len(senders) == len(set(map(str, senders)))
    last = {}
    for r in rows:
        last.setdefault((r[1], r[2]), []).append(r)
    for key, own in last.items():
        if key in {tuple(r) for r in ends}:
            inside = {r[3] for r in own if r[4] > own[-1][4] - dt.timedelta(hours=20) and r[3]}
            assert {r["user_map_key"][0] for r in senders if tuple(r["key"]) == key} == inside
    assert held("queue").filter(F.col("key").isNull()).count() == 0
