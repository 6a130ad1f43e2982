"""Bundles, videos, routing, filters, status, judging, providers and settings, against the cases that they come from and plain loops."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from echotrace import providers
from echotrace.config import settings
from echotrace.functions import images, names, payloads
from echotrace.operators import filters, forwards, judging, resolve, routing, similar, video
from echotrace.plans import catalogue

SF = "/root/testdata/sf0.001"
ZERO, HALF = "0" * 64, "f" * 32 + "0" * 32
VIDEO = "struct<sha256:string,frame_hashes:array<string>,duration_ms:int,metadata_hash:string,analysis:string>"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_settings():
    s = settings({"judge_context_window_seconds": "5", "judge_context_max_messages": 99, "forward_max_depth": None, "video_duplicate_enabled": "Yes", "url_only_exact_match": "no", "enable_llm_judge": "false", "url_tracking_params": [" A* ", ""], "video_frame_hash_threshold": "x", "blocked_groups": [1]})
    assert (s.judge_context_window_seconds, s.judge_context_max_messages, s.forward_max_depth, s.video_duplicate_enabled, s.url_only_exact_match) == (60, 40, 3, True, False)
    assert (s.enable_llm_judge, s.url_tracking_params, s.video_frame_hash_threshold, s.blocked_groups, s.min_text_length) == (True, ("a*",), 0.9, ["1"], 3)
    assert len(settings().url_tracking_params) == 13
    with pytest.raises(KeyError):
        settings({"no_such": 1})


def test_names(spark):
    n = lambda x: names.file_name(F.lit(x))
    r = one(spark, n("https://example.test/path/My%20Video.MP4?token=temporary").alias("a"), names.metadata_hash(n("my video.mp4"), F.lit(123)).alias("b"), n("C:\\d\\A+b%zz.mp4 ").alias("c"), n("base64://xx").alias("d"), names.local_path(F.lit("file:///tmp/a%20b")).alias("e"), names.local_path(F.lit("http://x")).alias("f"), names.declared_size(F.lit("0"), F.lit("4096")).alias("g"), names.metadata_hash(F.lit("x"), F.lit(0)).alias("h"), names.local_path(F.lit("a.mp4")).alias("i"))
    assert tuple(r) == ("my video.mp4", "ae99b7668acb88b459aa2428ebfdd5d46ab1968e6bec0b59aa79d882261afafb", "a+b%zz.mp4", "", "/tmp/a b", None, 4096, None, "a.mp4")
    r = one(spark, names.cached_at(F.lit("a/20240102_030405_x.png")).cast("string").alias("a"), names.expired_files(F.lit("20240102_030405_x.png"), F.lit("2024-01-20").cast("timestamp"), 7).alias("b"), names.expired_files(F.lit("x.png"), F.lit("2024-01-20").cast("timestamp"), 7).alias("c"))
    assert tuple(r) == ("2024-01-02 03:04:05", True, False)
    told = {"a%20b/C.mp4?x": "c.mp4", "file:///x/Y.mp4": "y.mp4", "": "", "data:x": "", "z" * 600: "sha256-" + hashlib.sha256(b"z" * 600).hexdigest()}
    for x, name in told.items():
        assert one(spark, n(x).alias("a"))["a"] == name


def test_image_hashes(spark, tmp_path):
    draw = random.Random(1)
    pixels = [draw.randrange(256) for _ in range(17 * 16)]
    want = f"{int(''.join(str(int(pixels[17 * r + c] > pixels[17 * r + c + 1])) for r in range(16) for c in range(16)), 2):064x}"
    assert one(spark, images.dhash(F.array(*[F.lit(x) for x in pixels])).alias("a"), images.dhash(F.array(F.lit(1))).alias("b"))[:] == (want, None)
    (tmp_path / "a.bin").write_bytes(b"abc")
    r = images.file_hashes(spark, str(tmp_path)).first()
    assert (r["size"], r["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())


def test_near_hashes_and_blocks(spark):
    draw = random.Random(2)
    base, rows = [draw.getrandbits(256) for _ in range(20)], []
    for i in range(120):
        h = draw.choice(base)
        for b in draw.sample(range(256), draw.randint(0, 30)):
            h ^= 1 << b
        rows.append((i, i % 2, h.to_bytes(32, "big")))
    df = spark.createDataFrame(rows, "id long, g int, h binary")
    apart = {(a, b): (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_count() for a, g, p in rows for b, k, q in rows if a < b and g == k}
    for most in (25, 110):
        got = [(r["a"], r["b"], r["distance"]) for r in similar.near_hashes(df, key="id", bits="h", width=256, most=most, group="g", size=25).collect()]
        assert sorted(got) == sorted((a, b, d) for (a, b), d in apart.items() if d <= most)
    best = {r["id"]: (r["matched_id"], r["similarity"]) for r in similar.best_hash(df, order="id", bits="h", group="g", threshold=0.9, size=25).collect()}
    for i, g, _ in rows:
        earlier = [(-(1 - apart[a, i] / 256), a) for a, k, _ in rows if a < i and k == g]
        assert best.get(i) == ((min(earlier)[1], -min(earlier)[0]) if earlier else None)
    vectors = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], None), (3, [], "b"), (4, None, "c"), (5, [1.0], "d"), (6, [0.9, 0.1], "a"), (7, [-1.0, 0.0], "")]
    df = spark.createDataFrame(vectors, "id long, v array<double>, who string")
    for size in (1, 3, 100):
        got = sorted((r["id"], r["matched_id"]) for r in similar.best_cosine(df, order="id", vector="v", threshold=0.9, size=size).collect())
        assert got == [(2, 1), (6, 1)]
        assert sorted(tuple(r) for r in similar.senders_by_cosine(df, order="id", vector="v", sender="who", threshold=0.9, size=size).collect()) == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (6, 1), (7, 0)]
    assert similar.best_cosine(df.limit(0), order="id", vector="v", threshold=0.9).count() == 0


def _video(sha=None, frames=(), ms=10000, meta=None, analysis="perceptual"):
    return sha, list(frames), ms, meta, analysis


def test_video_tiers(spark):
    rows = [
        (1, "g", "a", [_video(frames=[ZERO] * 5)]), (2, "g", "b", [_video("exact")]), (3, "g", "c", [_video("exact", [ZERO] * 4 + [HALF])]), (4, "g", "d", [_video(frames=[ZERO] * 3 + [HALF] * 2)]), (5, "g", "e", [_video(frames=[ZERO] * 5, ms=12000)]),
        (6, "g", "", [_video(meta="m", analysis="sha256")]), (7, "g", "f", [_video(meta="m", analysis="sha256")]), (8, "g", "f", [_video(meta="m", analysis="metadata")]), (9, "h", "x", [_video("exact")]), (10, "g", "y", None), (11, "g", "y", [_video(frames=["zz"] * 5)]),
        (12, "g", "z", [_video("other"), _video(frames=[ZERO] * 5, ms=10300)]),
    ]
    df = spark.createDataFrame(rows, f"id long, g string, who string, videos array<{VIDEO}>")
    got = {r["id"]: (r["matched_id"], r["match_type"]) for r in video.video_matches(df, group="g", order="id").collect()}
    assert got == {3: (2, "video_sha256"), 4: (3, "video_frame_hash"), 8: (6, "video_metadata"), 12: (1, "video_frame_hash")}
    who = {r["id"]: r["unique_senders"] for r in video.senders_by_video(df, group="g", order="id", sender="who").collect()}
    assert (who[3], who[8], who[12], who[10], who[9], who[6]) == (3, 1, 3, 0, 1, 0)


def test_video_fingerprints(spark):
    kind = "struct<name:string,declared_size:bigint,source:string,source_method:string,source_conflict:boolean,actual_size:bigint,readable:boolean,sha256:string,frame_hashes:array<string>,duration_ms:bigint,width:bigint,height:bigint>"
    made = lambda declared, actual, method="local", sha="s", frames=(), readable=True: ("n", declared, "/x", method, None, actual, readable, sha, list(frames), 10000 if frames else None, None, None)
    cases = [
        (made(100, 100), "sha256", False, 0), (made(200, 100, "component_path"), "sha256", True, -100), (made(101, 100), "unavailable", True, -1), (made(100, 100, readable=False), "unavailable", False, None), (made(101 << 20, None), "metadata", False, None),
        (made(None, 100, frames=["0" * 64] * 5), "perceptual", False, None), (made(None, 100, frames=["0" * 64] * 4), "sha256", False, None), (made(None, 101 << 20), "metadata", False, None), (made(100, None, "http", None), "sha256", False, None),
    ]
    df = spark.createDataFrame([(k, [c[0]]) for k, c in enumerate(cases)], f"k int, v array<{kind}>").withColumn("f", video.fingerprints(F.col("v")))
    rows = [r["f"][0] for r in df.orderBy("k").collect()]
    assert [(r["analysis"], r["size_mismatch"], r["size_delta_bytes"]) for r in rows] == [c[1:] for c in cases]
    assert rows[2]["sha256"] is None and rows[4]["metadata_hash"] and rows[1]["size_ratio"] == 0.5
    assert [r["u"] for r in df.select("k", video.is_usable(F.col("f")).alias("u")).orderBy("k").collect()] == [True, True, False, False, True, True, True, True, False]


def test_bundles(spark):
    image = lambda token, size: {"type": "video", "data": {"file": f"https://x.test/v.mp4?token={token}", "file_size": size}}
    key = lambda data, kind, named=True: one(spark, (payloads.video_key if kind == "video" else lambda v: payloads.media_key(v, F.lit(named)))(F.parse_json(F.lit(json.dumps(data)))).alias("k"))["k"]
    assert key(image("a", 9)["data"], "video") == key(image("b", 9)["data"], "video") != key(image("b", 10)["data"], "video") and payloads.HASH_VERSION == 4
    assert key({"url": "https://x/v?fileid=A%20b"}, "video") == "fileid:a b" and key({"size": 3}, "video") is None and key({"file_id": " Q "}, "video") == "file_id:q"
    assert key({"file": "https://x/a?MD5=Q&t=1"}, "image", False) == "file:x/a?md5=q" and key({"name": "N"}, "image", False) is None and key({"name": "N"}, "file") == "name:n" and key({"file": "a.png?x"}, "image") == "file:a.png"
    text = lambda t: {"type": "text", "data": {"text": t}}
    node = lambda *parts, who="1": {"sender": {"user_id": who, "nickname": f"n{who}"}, "message": list(parts)}
    table = {
        "plain": {"data": {"messages": [node(text("hello  world")), node(text("enough text to be told apart"), {"type": "face", "data": {"id": 3}}, who="2")]}},
        "nested": [{"type": "node", "data": {"user_id": 5, "content": [{"type": "forward", "data": {"id": "plain"}}]}}, node({"type": "forward", "data": {"id": "gone"}}), node(text("long enough to be visible"))],
        "loop": [node({"type": "forward", "data": {"id": "loop"}})], "lost": [node({"type": "forward", "data": {"id": "nowhere"}})], "media": {"nodes": [node({"type": "image", "data": {"file": "a.png?x"}}, image("t", 4), {"type": "odd", "data": {"url": "u", "k": None}})]},
        "long": {"messages": [node(text("x" * 13000))]}, "empty": {"messages": []},
    }
    rows = [(k, json.dumps(v), False) for k, v in table.items()] + [("gone", None, True), ("broken", "{", False)]
    known = spark.createDataFrame(rows, "id string, payload string, unavailable boolean")
    got = {r["forward_id"]: r for r in forwards.expand_forwards(known.select(F.col("id").alias("forward_id")).unionByName(spark.createDataFrame([("absent",), ("",)], "forward_id string")), known).collect()}
    said = [{"segments": [{"text": "hello world", "type": "text"}], "sender_id": "1", "sender_name": "n1"}, {"segments": [{"text": "enough text to be told apart", "type": "text"}, {"id": "3", "type": "face"}], "sender_id": "2", "sender_name": "n2"}]
    assert got["plain"]["forward_hash"] == hashlib.sha256(json.dumps(said, separators=(",", ":")).encode()).hexdigest() and got["plain"]["forward_text_hash"] and got["plain"]["forward_content"] == "[合并转发]\nn1: hello world\nn2: enough text to be told apart [表情:3]"
    assert got["nested"]["forward_partial"] and got["nested"]["forward_hash"] and not got["nested"]["forward_truncated"] and got["nested"]["forward_node_count"] == 5 and "[内层转发：内容不可读取]" in got["nested"]["forward_content"]
    assert all(got[k]["forward_truncated"] and got[k]["forward_hash"] is None for k in ("loop", "lost", "long", "broken", "absent", "gone")) and "" not in got
    assert got["media"]["has_image"] and got["media"]["has_video"] and got["media"]["forward_hash"] and got["empty"]["forward_hash"] is None and len(got["long"]["forward_content"]) < 12100
    assert one(spark, forwards.is_unavailable(F.lit("X Message Expired")).alias("a"), forwards.is_unavailable(F.lit("timeout")).alias("b"), forwards.is_unavailable(F.lit(None)).alias("c"))[:] == (True, False, False)
    few = {r["forward_id"]: r for r in forwards.expand_forwards(known.select(F.col("id").alias("forward_id")), known, limits=payloads.Limits(depth=1, nodes=1), sender_text=False).collect()}
    assert few["plain"]["forward_truncated"] and few["plain"]["forward_text_hash"] is None and few["nested"]["forward_node_count"] == 1
    stored = spark.createDataFrame([(2, "g", "a", "c2", 4, "h", None, True), (1, "g", "a", "c1", 4, None, None, False), (3, "g", "b", "c", 3, "h", "t", True), (4, "g", "c", "c", 4, "h", "t", True), (5, "g", "d", "c", 4, None, None, None)], "id long, g string, forward_id string, content string, forward_hash_version int, forward_hash string, forward_text_hash string, forward_text_hash_eligible boolean")
    stored = stored.withColumns({"forward_content": F.lit(""), "forward_node_count": F.lit(2).cast("long"), "forward_truncated": F.col("id") == 1, "forward_partial": F.lit(False), "has_image": F.lit(False), "has_video": F.lit(False)})
    assert [(r["forward_id"], r["forward_content"]) for r in forwards.known_forwards(stored, group="g", order="id").collect()] == [("c", "c")]
    assert sorted(r["forward_id"] for r in forwards.known_forwards(stored, group="g", order="id", sender_text=False).collect()) == ["c", "d"]


def test_video_components(spark):
    parts = "array<struct<type:string,id:string,path:string,url:string,file:string,readable:boolean>>"
    raw = "array<struct<type:string,data:map<string,string>>>"
    clip = lambda **k: ("Video", None, k.get("path"), k.get("url"), k.get("file"), k.get("readable", False))
    segment = lambda **k: ("video", k)
    rows = [
        (1, [clip(url="u", file="f.mp4"), clip(path="/a/B.mp4", readable=True), clip(file="c"), clip(file="d")], [("text", {}), segment(file="r%20.MP4", url="v", file_size="4096"), segment(size="-1")]),
        (2, None, None), (3, [clip()], [segment(file="x", name="n")]),
    ]
    df = spark.createDataFrame(rows, f"k int, c {parts}, r {raw}").select("k", routing.video_components(F.col("c"), F.col("r")).alias("v")).orderBy("k")
    a, b, c = (r["v"] for r in df.collect())
    assert [(v["name"], v["declared_size"], v["source"], v["source_method"], v["source_conflict"]) for v in a] == [("r .mp4", 4096, "v", "raw_url", True), ("b.mp4", None, "/a/B.mp4", "component_path", False), ("c", None, "c", "component_file", False)]
    assert b == [] and [(v["source"], v["source_method"], v["name"]) for v in c] == [("x", "raw_file", "x")]


def test_routed_messages_are_filtered(spark):
    out = catalogue.routed(spark, SF)
    kept = filters.kept(out, settings({"blocked_groups": [1], "min_text_length": 3, "ignore_regex": ["see .*"]}), commands=["text"], own_id="me")
    rows = kept.select("page_id", "group_id", "modality", "content").collect()
    assert rows and all(r["group_id"] != "1" and not r["content"].startswith("see ") for r in rows) and {r["modality"] for r in rows} <= {"text", "forward", "video", "image"} and not any(r["page_id"] % 10 == 1 for r in rows)
    assert filters.kept(out, settings(), own_id="u").count() == 0 and filters.kept(out.limit(0), settings()).count() == 0
    many = filters.without_blocked(spark.range(10).selectExpr("cast(id as string) g"), "g", [str(k) for k in range(5)] * 300)
    assert many.count() == 5
    plugins = spark.createDataFrame([(True, "b", ["c", ""], None), (True, None, None, "a"), (False, "x", None, None), (True, "b", None, "")], "active boolean, command string, aliases array<string>, command_group string")
    assert [r["text"] for r in filters.command_lines(spark, filters.plugin_commands(plugins), 2).collect()] == ["a  b", "c"]


def test_resolution(spark):
    messages = spark.createDataFrame([(k, k * 10) for k in range(1, 9)], "id long, ts int")
    of = lambda *rows: spark.createDataFrame(rows, "id long, matched_id long, match_type string")
    got = resolve.resolve(messages, order="id", ts="ts", url=of((3, 1, None)), forward=of((3, 2, "forward_id"), (4, 2, "forward_hash")), vector=of((4, 3, None), (5, 4, None), (6, 2, None)), image=of((3, 1, None), (5, 2, None), (6, 4, None), (7, 6, None)))
    assert sorted(tuple(r) for r in got.collect()) == [(3, 1, "url_hash"), (4, 3, "embedding"), (5, 2, "image_hash"), (6, 2, "embedding"), (7, 6, "image_hash")]
    assert resolve.resolve(messages, order="id", ts="ts", video=of((2, 1, "video_sha256"))).collect()[0]["match_type"] == "video_sha256"


def test_judging(spark):
    rows = [(k, "g", str(k % 3), text, float(t)) for k, (text, t) in enumerate([("same  text", 8800), ("same text", 9699), ("same text", 9760), ("same text", 9820), ("other", 9940), ("same\ttext", 10000)])]
    df = spark.createDataFrame(rows, "id long, g string, who string, text string, t double").withColumn("ts", F.timestamp_seconds("t"))
    options = dict(group="g", order="id", ts="ts")
    stats = judging.judge_statistics(df, sender="who", content="text", window_s=300, **options)
    r = stats.filter("id = 5").first()
    assert (r["messages_in_window"], r["exact_repeat_count"], r["exact_unique_senders"], r["exact_span_seconds"], r["longest_consecutive_exact"]) == (4, 3, 2, 240, 2)
    text = stats.filter("id = 5").select(judging.statistics_text(300, stats).alias("t")).first()["t"]
    assert text.splitlines()[0] == "- 统计窗口：最近300秒" and "3次，涉及2名发送者" in text and "02:42:40 至 01-01 02:46:40" in text
    marks = spark.createDataFrame([(5, 0)], "id long, matched_id long")
    parts = lambda **k: sorted((r["part"], r["row_id"]) for r in judging.judge_contexts(df, marks, **options, **k).collect())
    assert parts(window_s=300, most=4) == [("history", 0), ("history", 1), ("recent", 2), ("recent", 3), ("recent", 4)]
    assert parts(window_s=3600, most=4) == [("recent", k) for k in (1, 2, 3, 4)]


def test_longest_runs_equal_a_plain_loop(spark):
    draw = random.Random(7)
    at, rows = 0, []
    for k in range(400):
        at += draw.choice([0, 1, 1, 5, 40])
        rows.append((k, "g", "w", draw.choice(["x", "x", "y", ""]), at))
    df = spark.createDataFrame(rows, "id long, g string, who string, text string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["id"]: r for r in judging.judge_statistics(df, group="g", order="id", ts="ts", sender="who", content="text", window_s=30).collect()}
    for k, _, _, text, t in rows:
        window, best, run = [r for r in rows[: k + 1] if r[4] >= t - 30], 0, 0
        for r in window:
            run = run + 1 if text and r[3] == text else 0
            best = max(best, run)
        assert (got[k]["messages_in_window"], got[k]["longest_consecutive_exact"]) == (len(window), best)


def test_providers(spark):
    assert [providers.vision_answer(t) for t in ('```json\n{"is_sticker": "yes"}```', '{"content": "cat"}', '{"type": "Emoji", "content": "c"}', "a sticker", "plain", "", None)] == [None, "cat", None, None, "plain", None, None]
    assert [providers.judge_answer(t) for t in ('```\n{"should_remind": true}\n```', 'x "should_remind": TRUE', "{}", None)] == [True, True, False, False]
    assert "{x}" not in providers.judge_prompt(dict.fromkeys(("content", "matched", "history", "recent", "stats"), "v"), "bad {x}")

    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None), (4, "ab")], "id long, c string")
    assert [r["embedding"] for r in providers.embed(df, "c", embed).orderBy("id").collect()] == [[2.0], None, None, [2.0]]
    assert providers.embed(df, "c", None).filter("embedding is null").count() == 4
    pictures = spark.createDataFrame([(1, ["a", "s"]), (2, []), (3, ["a"])], "id long, sources array<string>")
    shown = providers.describe_images(pictures, "sources", lambda xs: ["sticker" if x == "s" else f'{{"content": "{x}!"}}' for x in xs])
    assert [r["described"] for r in shown.orderBy("id").collect()] == [{"a": "a!"}, {}, {"a": "a!"}]
    verdicts = spark.createDataFrame([(1, "remind"), (2, "cooldown"), (3, "remind"), (4, "remind")], "id long, verdict string")
    prompts = spark.createDataFrame([(1, "yes"), (2, "yes"), (3, "no")], "id long, prompt string")
    judged = providers.judge(verdicts, prompts, lambda xs: [f'{{"should_remind": {str(x == "yes").lower()}}}' for x in xs], order="id")
    assert sorted(tuple(r) for r in judged.collect()) == [(1, "remind"), (2, "cooldown"), (3, "judged_no"), (4, "judged_no")]
    videos = spark.createDataFrame([("s", "r1", "raw_url"), ("s", "r2", "raw_url"), ("s", "r1", "component_path"), ("s", "r3", "raw_file")], "source string, file_reference string, source_method string")
    files = spark.createDataFrame([("r1", "/p", "u", 5, True), ("r2", "/p", "u", 6, False)], "reference string, path string, url string, size long, readable boolean")
    assert sorted((r["source"], r["source_method"]) for r in providers.with_files(videos, files).collect()) == [("/p", "get_file_local"), ("s", "component_path"), ("s", "raw_file"), ("u", "get_file_http")]
    replies = providers.can_reply(spark.createDataFrame([("1",), ("2",), ("3",)], "message_id string"), spark.createDataFrame([("1", "ok", 0), ("2", "FAILED", None), ("3", None, 5)], "message_id string, status string, retcode int"))
    assert sorted((r["message_id"], r["can_reply"]) for r in replies.collect()) == [("1", True), ("2", False), ("3", False)]
