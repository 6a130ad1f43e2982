"""Provider answers that are kept, and the way from messages to judged verdicts."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from echotrace import providers
from echotrace.cache import Cache
from echotrace.operators import prompts
from echotrace.plans import flow

START = dt.datetime(2024, 1, 1)
CLIPS = "array<struct<sha256:string,frame_hashes:array<string>,duration_ms:bigint,metadata_hash:string,analysis:string>>"
SCHEMA = f"id long, group_id string, ts timestamp, sender_id string, content string, url_hash string, forward_id string, forward_hash string, forward_text_hash string, videos {CLIPS}, embedding array<double>, image_bits binary"


def test_a_content_is_asked_once(spark, tmp_path):
    calls = f"{tmp_path}/calls"
    os.makedirs(calls)

    def counting(texts):
        import uuid

        for t in texts:
            with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(k, ["aa", "b", "bad", None, "cccc"][k % 5]) for k in range(200)], "id long, c string").repartition(7)
    cache = Cache(spark, f"{tmp_path}/cache", "array<double>")
    for n in (1, 2):
        got = {r["c"]: r["v"] for r in cache.ask(rows, "c", "v", counting).collect()}
        assert got == {"aa": [2.0], "b": [1.0], "bad": None, None: None, "cccc": [4.0]}
        assert cache.ask(rows.limit(0), "c", "v", counting).count() == 0
        seen = [open(f"{calls}/{f}").read() for f in os.listdir(calls)]
        assert all(seen.count(x) >= 1 for x in ("aa", "b", "cccc"))
        if n == 1:
            first = {x: seen.count(x) for x in ("aa", "b", "cccc")}
    # the second run asked for nothing but what had failed
    assert {x: seen.count(x) for x in first} == first and cache.known().count() == 3
    assert not [f for f in os.listdir(f"{tmp_path}/cache") if f.startswith("_open")]


def test_messages_become_judged_verdicts(spark):
    hour = lambda h: START + dt.timedelta(hours=h)
    clip = [("s", [], 0, None, "sha256")]
    row = lambda id_, h, who, content, **of: (id_, "g", hour(h), who, content, *[of.get(c) for c in ("url", "fid", "fh", "ft", "videos", "v", "bits")])
    rows = [
        row(1, 0, "a", "http://x", url="u"), row(2, 1, "b", "http://x", url="u"), row(3, 5, "c", "http://x", url="u"), row(4, 6, "a", "http://x", url="u"), row(5, 6, "d", "x", videos=clip), row(6, 9, "e", None, videos=clip), row(7, 10, "f", "", videos=clip), row(8, 11, "f", "y"),
        row(9, 12, "a", "cat", v=[1.0, 0.0]), row(10, 20, "b", "the cat", v=[1.0, 0.1]), row(11, 30, "c", "cats", v=[0.9, 0.0]), row(12, 300, "c", "http://x", url="u"), row(13, 301, "d", "", bits=b"\x00\x01"), row(14, 302, "e", "", bits=b"\x00\x00"),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    found = {r["id"]: tuple(r)[1:] for r in flow.reminders(table, cooldown_s=7200).collect()}
    assert found == {
        1: (None, None, 0, "no_match"), 2: (1, "url_hash", 2, "few_senders"), 3: (1, "url_hash", 3, "remind"), 4: (1, "url_hash", 3, "same_sender"), 5: (None, None, 0, "no_match"), 6: (5, "video_sha256", 2, "few_senders"), 7: (5, "video_sha256", 3, "remind"),
        9: (None, None, 0, "no_match"), 10: (9, "embedding", 2, "few_senders"), 11: (9, "embedding", 3, "remind"), 12: (None, None, 0, "no_match"), 13: (None, None, 0, "no_match"), 14: (13, "image_hash", 2, "few_senders"),
    }
    cut = hour(5)
    later = {r["id"]: tuple(r)[1:] for r in flow.reminders(table.filter(F.col("ts") >= cut), table.filter(F.col("ts") < cut), cooldown_s=7200).collect()}
    assert later == {k: v for k, v in found.items() if k > 2}
    verdicts = flow.reminders(table, cooldown_s=7200)
    asked = prompts.judge_prompts(table, verdicts.filter("verdict = 'remind'").select("id", "matched_id"), group="group_id", order="id", ts="ts", sender="sender_id", content="content", window_s=4 * 3600)
    told = {r["id"]: r for r in asked.collect()}
    assert set(told) == {3, 7, 11} and told[7]["history"] == "" and told[7]["recent"].split("\n") == ["01-01 06:00:00 a: http://x", "01-01 06:00:00 d: x", "01-01 09:00:00 e: （无文字内容）"]
    assert told[3]["content"] == told[3]["matched"] == "http://x" and "精确出现：2次，涉及2名发送者" in told[3]["stats"] and told[3]["stats"] in told[3]["prompt"] and '{"should_remind": true or false' in told[3]["prompt"]
    judged = providers.judge(verdicts, asked, lambda texts: ['{"should_remind": %s}' % str("cats" in t).lower() for t in texts], order="id")
    assert {r["id"]: r["verdict"] for r in judged.collect() if r["id"] in told} == {3: "judged_no", 7: "judged_no", 11: "remind"}


def test_contexts_keep_to_their_budget(spark):
    rows = spark.createDataFrame([(k, "g", START + dt.timedelta(seconds=k), "w", "x" * 20) for k in range(30)], "id long, g string, ts timestamp, who string, c string")
    marks = spark.createDataFrame([(29, 0)], "id long, matched_id long")
    r = prompts.judge_prompts(rows, marks, group="g", order="id", ts="ts", sender="who", content="c", window_s=100, most=12, most_chars=200).first()
    assert len(r["recent"]) <= 200 and r["recent"].split("\n")[-1].startswith("01-01 00:00:28 w: ") and r["recent"].count("\n") == 4
    with pytest.raises(ValueError):
        prompts.judge_prompts(rows, marks, group="g", order="id", ts="ts", sender="who", content="c", template="{nobody}")
