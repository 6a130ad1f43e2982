"""Sessions on a stream that comes out of order, against the batch."""

import datetime as dt
import random

from echotrace.streaming import sessions

SCHEMA = "id long, k string, who string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def test_stream_equals_batch_and_late_ones_are_counted(spark, tmp_path):
    draw = random.Random(2)
    times = sorted(draw.randrange(400_000) for _ in range(300))
    rows = [(k, draw.choice("abc"), draw.choice("xyz"), START + dt.timedelta(seconds=t)) for k, t in enumerate(times)]
    out_of_order = sorted(rows, key=lambda r: (r[3] - START).total_seconds() + draw.randrange(3000))
    end = [(1000, "end", "x", START + dt.timedelta(days=30))]
    options = {"key": ["k"], "ts": "ts", "sender": "who", "gap_s": 2000}
    late = [(2000 + k, "a", "x", START + dt.timedelta(seconds=9000 * k)) for k in range(7)]
    dropped = 0
    for part in (out_of_order[:100], out_of_order[100:200], out_of_order[200:], end, late):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = sessions.start(sessions.repeat_sessions(stream, late_s=3600, **options), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        dropped += sessions.left_out(query)
    want = sessions.repeat_sessions(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select("k", "started", "ended", "times", "senders").collect())) == sorted(map(str, want))
    assert dropped == 7 and len(want) > 20
