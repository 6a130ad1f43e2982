import datetime as dt
import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.functions import fuzzy
from echotrace.functions import similarity as S
from echotrace.functions import text as X
from echotrace.functions import urls
from echotrace.operators import repeats, search
from echotrace.plans import catalogue
from echotrace.sources import messages as M
from echotrace.streaming.repeats import stream_verdicts


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_urls(spark):
    good = {
        " <HTTPS://Example.COM:443/a?b=2&utm_source=x&a=1#f> ": "https://example.com/a?a=1&b=2", "http://example.com": "http://example.com/", "http://example.com:8080/x;p?q=~*%20": "http://example.com:8080/x;p?q=~%2A+",
        "http://h/a;": "http://h/a", "http://h/a;b;": "http://h/a;b;", "http://@h/a": "http://h/a", "http://h:0/": "http://h/", "http://h:/?": "http://h/", "http://h?a=b=c&d": "http://h/?a=b%3Dc&d=", "HTTP://[::1]:80/x": "http://[::1]/x",
        "http://bücher.de/ü?ü=1&=3&a": "http://xn--bcher-kva.de/ü?=3&a=&%C3%BC=1", "http://H/P?B=1&b=2&B=0&UTM_x=1": "http://h/P?B=0&B=1&b=2", "http://h/\u3000": "http://h/",
    }
    bad = [None, "", "see http://example.com", "http://u@example.com/", "ftp://example.com", "http://example.com:99999/", "http://" + "a" * 9000, "http://a..b/", "http://[::1/x", "<>", "http://"]
    rows = spark.createDataFrame([(u, v) for u, v in good.items()] + [(u, None) for u in bad], "u string, v string")
    assert [(r["u"], r["n"]) for r in rows.withColumn("n", urls.normalised(F.col("u"))).collect()] == [(r["u"], r["v"]) for r in rows.collect()]
    r = one(spark, urls.url_host(F.lit("http://h:80/x")).alias("a"), urls.url_host(F.lit("http://[::1]/x")).alias("b"), urls.normalised(F.lit("http://h/?Aa=1&b=2"), ("a*",)).alias("c"))
    assert (r["a"], r["b"], r["c"]) == ("h", "[::1]", "http://h/?b=2")
    print_of = lambda u: urls.fingerprint(F.lit(u))
    late = lambda c, only, old, **k: urls.current_fingerprint(F.lit(c), F.lit(only), F.lit(old), **k)
    r = one(spark, (late("http://h/?utm_x=1", False, "old") == print_of("http://h/")).alias("a"), late("text", False, "old").alias("b"), late("http://h /", None, "old").alias("c"), late("http://h/", True, "old", on=False).alias("d"))
    assert (r["a"], r["b"], r["c"], r["d"]) == (True, "old", "old", None)


def test_text(spark):
    ts = F.lit(dt.datetime(2024, 7, 29, 12, 34, 56))
    now = F.lit(dt.datetime(2024, 7, 29, 12, 39, 56))
    r = one(spark, X.squeeze(F.lit(" a　 b\n")).alias("a"), X.summary(F.lit(None).cast("string"), ts, now, F.lit(" ")).alias("b"), X.shorten(F.lit("x" * 90)).alias("c"), X.positive_int(F.lit("4096")).alias("d"), X.positive_int(F.lit("-3")).alias("e"))
    assert r["a"] == "a b" and r["b"] == "未知 · 07-29 12:34:56（5分钟前）\n（无文字内容）" and r["c"] == "x" * 80 + "…" and r["d"] == 4096 and r["e"] is None
    r = one(spark, X.image_description(F.lit(""), F.lit("hi [图片内容: 一只猫]")).alias("a"), X.is_command(F.lit("/help me"), ["help"]).alias("b"), X.is_command(F.lit("记忆状态"), ["记忆状态", "help"]).alias("c"), X.fully_matches(F.lit("ab\n"), ["ab", "("]).alias("d"))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("一只猫", True, False, False)
    r = one(spark, X.is_command(F.lit("\u3000/help"), ["help"]).alias("a"), X.fully_matches(F.lit("abab"), [r"(?P<n>ab)(?P=n)", "("]).alias("b"), X.search_form(F.lit("STRASSE  ẞß")).alias("c"), X.search_query(F.lit(" /搜图 橙色 猫 ")).alias("d"), X.search_query(F.lit("搜图x")).alias("e"), X.epoch(F.lit("x")).alias("f"), X.epoch(F.lit("1.5")).alias("g"))
    assert tuple(r) == (True, True, "strasse ssss", "橙色 猫", None, 0.0, 1.5)
    full = X.summary(F.lit("a"), ts, now, F.lit("x"), forward=F.lit(True), nodes=F.lit(3), partial=F.lit(True), image=F.lit(True), video=F.lit(None).cast("boolean"))
    assert one(spark, full.alias("a"))["a"] == "a · 07-29 12:34:56（5分钟前） · 转发3条 · 部分内容 · 含图片\nx"


def test_similarity(spark):
    v = F.array(F.lit(1.0), F.lit(0.0))
    r = one(spark, S.cosine(v, v, S.norm(v), S.norm(v)).alias("a"), S.cosine(v, F.array(F.lit(1.0)), S.norm(v), F.lit(1.0)).alias("b"), S.hex_similarity(F.lit("f" * 32 + "0" * 32), F.lit("0" * 64)).alias("c"), S.hex_similarity(F.lit("zz"), F.lit("00")).alias("d"))
    assert r["a"] == 0.9999999989999999 and r["b"] == 0 and r["c"] == 0.5 and r["d"] == 0
    zero, half = "0" * 64, "f" * 32 + "0" * 32
    frames = lambda bad: F.array(*[F.lit(half if k >= 5 - bad else zero) for k in range(5)])
    match = lambda bad, ms: S.frames_match(frames(0), frames(bad), F.lit(10000), F.lit(ms))
    r = one(spark, match(1, 10000).alias("a"), match(2, 10000).alias("b"), match(0, 12000).alias("c"))
    assert (r["a"], r["b"], r["c"]) == (True, False, False)


def test_search(spark):
    rows = spark.createDataFrame([(0, "一只橙色的猫趴在窗台", 300), (1, "橙色 猫 正在晒太阳", 100)], "id int, text string, ts int")
    assert [r["id"] for r in search.ranked(rows, "橙色 猫", text="text", order="id", recency="ts").collect()] == [1, 0]
    rows = spark.createDataFrame([(0, "Night SKY", 100), (1, "night   sky", 200)], "id int, text string, ts int")
    assert [r["id"] for r in search.ranked(rows, "NIGHT sky", text="text", order="id", recency="ts").collect()] == [1, 0]
    rows = spark.createDataFrame([(0, "窗台上有一只橙色的猫", 1)], "id int, text string, ts int")
    r = search.ranked(rows, "橙色猫", text="text", order="id", recency="ts", fuzzy_from=0.65).first()
    assert r["match_type"] == "fuzzy" and r["fuzzy"] >= 0.65
    assert search.ranked(rows, " ", text="text", order="id", recency="ts").count() == 0
    rows = spark.createDataFrame([(0, "猫", 100, [1.0, 0.0]), (1, "飞机", 200, [0.0, 1.0])], "id int, text string, ts int, v array<double>")
    assert [(r["id"], r["match_type"]) for r in search.ranked(rows, "宠物", text="text", order="id", recency="ts", vector="v", asked=[1, 0]).collect()] == [(0, "semantic")]
    rows = spark.createDataFrame([(0, "宠物用品清单", 100, [0.0, 1.0]), (1, "猫", 200, [1.0, 0.0]), (2, None, 1, None)], "id int, text string, ts int, v array<double>")
    found = search.ranked(rows, "宠物", text="text", order="id", recency="ts", vector="v", asked=[1, 0])
    assert [(r["id"], r["match_type"]) for r in found.collect()] == [(0, "phrase"), (1, "semantic")]
    r = search.best_and_count(found, recency="ts", order="id").first()
    assert (r["id"], r["found"]) == (0, 2) and search.ranked(rows, "宠物", text="text", order="id", recency="ts", top=1).count() == 1


def least_edits(asked, text):
    """Of any stretch of the text, by whole columns."""
    column = list(range(len(asked) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for k, a in enumerate(asked):
            new.append(min(column[k + 1] + 1, new[k] + 1, column[k] + (a != c)))
        column, best = new, min(best, new[-1])
    return best


@pytest.mark.parametrize("n", [1, 3, 10, 63, 64, 65, 130])
def test_letters_equal_whole_columns(n):
    draw = random.Random(n)
    asked = "".join(draw.choice("ab猫") for _ in range(n))
    texts = ["", asked, f"x{asked}y", *("".join(draw.choice("ab猫d😀") for _ in range(draw.randint(0, 200))) for _ in range(60))]
    whole = [t for t in texts if len(t) >= n]
    assert fuzzy.fewest_edits(asked, whole).tolist() == [least_edits(asked, t) for t in whole]
    short = [(1 - least_edits(t, asked) / len(t)) if t else 0.0 for t in texts if len(t) < n]
    assert np.allclose(fuzzy.likeness(asked, texts), [1 - least_edits(asked, t) / n if len(t) >= n else short.pop(0) for t in texts])
    assert fuzzy.likeness("", texts).max() == 0


def brute_search(docs, asked, vector, fuzzy_from, semantic_from):
    """What a search has to find, row by row."""
    out, words = [], asked.casefold().split()
    for doc_id, text, recency, own in docs:
        plain = (text or "").casefold()
        if not plain.strip():
            continue
        near = 0.0
        if own is not None and len(own) == len(vector):
            near = sum(a * b for a, b in zip(own, vector)) / (math.sqrt(sum(a * a for a in own)) * math.sqrt(sum(b * b for b in vector)) + 1e-9)
        near = min(max(near, 0.0), 1.0)
        short, long = sorted(("".join(asked.casefold().split()), "".join(plain.split())), key=len)
        like = 1 - least_edits(short, long) / len(short)
        hits = sum(w in plain for w in words)
        squeezed = " ".join(plain.split())
        kind = "phrase" if hits == len(words) and asked in squeezed else "keywords" if hits == len(words) else "semantic" if near >= semantic_from else "fuzzy" if like >= fuzzy_from else None
        if kind:
            times = sum(plain.count(w) for w in words)
            out.append(((kind == "phrase", hits == len(words), near, like, hits, times, recency), (doc_id, kind, round(near, 9), round(like, 9), hits, times)))
    return out


def test_hybrid_search_finds_all(spark, tmp_path):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").filter("doc_id % 3 = 0")
    odd = spark.createDataFrame([(10**6, "INFORMATİON ABOUT THE ſea", "en", "s", 1), (10**6 + 1, None, "en", "s", 1), (10**6 + 2, " \n ", "en", "s", 1), (10**6 + 3, "informtion about the", "en", "s", 1), (10**6 + 4, "The\tabout  INFORMATION", "en", "s", 1), (10**6 + 5, "z", "en", "s", 1), (10**6 + 6, "INFORMATION\u3000about  the ﬁsh", "en", "s", 1)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{base}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    rows = [(r.doc_id, r.text, float(r.n_chars), vectors.get(r.doc_id)) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    want = brute_search(rows, catalogue.ASKED, catalogue.ASKED_VECTOR, 0.65, 0.2)
    found = catalogue.hybrid_search(spark, str(tmp_path)).collect()
    assert {w[1][1] for w in want} == {"phrase", "keywords", "semantic", "fuzzy"}
    assert sorted(tuple(r) for r in found) == sorted(w[1] for w in want)
    place = {w[1][0]: (*w[0][:2], round(w[0][2], 6), *w[0][3:]) for w in want}
    assert [place[r.doc_id] for r in found] == sorted(place.values(), reverse=True)


def test_ranked_search_folds_once(spark):
    plan = catalogue.ranked_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("{1e9e}-") <= 1 and plan.count("ArrowEvalPython [") <= 1


def test_verdicts_and_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "g", "x", "a", t), (2, "g", "x", "b", t + dt.timedelta(hours=2)), (3, "g", "x", "c", t + dt.timedelta(hours=4)), (4, "g", None, "a", t), (5, "g", None, "b", t), (6, "g", "x", "a", t + dt.timedelta(days=30))]
    df = spark.createDataFrame(rows, "id int, g string, k string, who string, ts timestamp")
    got = {r["id"]: (r["matched_id"], r["unique_senders"], r["verdict"]) for r in repeats.repeat_verdicts(df, key=["g", "k"], order="id", ts="ts", sender="who").collect()}
    assert got == {1: (None, 1, "no_match"), 2: (1, 2, "few_senders"), 3: (1, 3, "remind"), 4: (None, 1, "no_match"), 5: (None, 1, "no_match"), 6: (None, 1, "no_match")}
    rows = [(k, "g", "x", who, t + dt.timedelta(hours=h)) for k, (who, h) in enumerate([("a", 0), ("b", 1), ("a", 1), (None, 2), ("c", 168), ("b", 169), ("d", 170), ("a", 400), ("a", 400), ("b", 568)])]
    tied = spark.createDataFrame(rows, "id int, g string, k string, who string, ts timestamp")
    week = dt.timedelta(days=7)
    for r in repeats.look_back(tied, key=["g", "k"], order="id", ts="ts", sender="who", window_us=7 * repeats.DAY * repeats.SECOND).collect():
        me = rows[r["id"]]
        seen = sorted((x[4], x[0], x[3]) for x in rows if me[4] - week < x[4] and (x[4], x[0]) <= (me[4], me[0]))
        assert (r["seen"], r["senders"], r["first"]["id"]) == (len(seen), len({x[2] for x in seen} - {None}), seen[0][1])
    assert repeats.repeat_verdicts(df.limit(0), key=["g", "k"], order="id", ts="ts", sender="who").count() == 0


def test_shards(spark, tmp_path):
    (tmp_path / "g1").mkdir()
    with gzip.open(tmp_path / "g1/2024-01-02.json.gz", "wt") as f:
        json.dump([{"id": "a", "content": "x", "timestamp": 5}, {"id": "b", "videos": [{"sha256": "s"}]}], f)
    rows = M.read_shards(spark, f"{tmp_path}/*/*.json.gz")
    assert sorted((r["id"], r["group_id"], str(r["event_date"])) for r in rows.collect()) == [("a", "g1", "2024-01-02"), ("b", "g1", "2024-01-02")]
    with gzip.open(tmp_path / "g1/2024-01-03.json.gz", "wt") as f:
        f.write("[{broken")
    with open(tmp_path / "g1/2024-01-09.json", "w") as f:
        json.dump([{"id": "c", "timestamp": 2.5}, {"id": "d"}], f)
    shards = f"{tmp_path}/g1/*.json*"
    assert sorted(r["id"] for r in M.read_shards(spark, shards).collect()) == ["a", "b", "c", "d"]
    assert sorted(r["id"] for r in M.read_shards(spark, shards, today="2024-01-09", days=6).collect()) == ["c", "d"]
    assert [r["path"].rsplit("/")[-1] for r in M.broken_shards(spark, shards).collect()] == ["2024-01-03.json.gz"]
    assert [(r["id"], r["seq"]) for r in M.in_order(M.read_shards(spark, shards)).orderBy("seq").collect()] == [("b", 1), ("d", 2), ("c", 3), ("a", 4)]
    with open(tmp_path / "g 2_messages.json", "w") as f:
        json.dump([{"id": "e", "timestamp": 86400 * 3 + 1}, {"id": "f", "timestamp": 86400 * 3 + 2}, {"id": "h", "timestamp": 86400 * 4}], f)
    old = M.read_legacy(spark, f"{tmp_path}/*_messages.json")
    assert sorted((r["id"], r["group_id"], str(r["event_date"])) for r in old.collect()) == [("e", "g 2", "1970-01-04"), ("f", "g 2", "1970-01-04"), ("h", "g 2", "1970-01-05")]
    out = f"{tmp_path}/out"
    M.write_messages(M.read_shards(spark, shards), out)
    M.write_messages(old, out)
    M.write_messages(old.filter("id = 'h'"), out, mode="overwrite")  # one day alone
    stored = lambda: sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert stored() == ["a", "b", "c", "d", "e", "f", "h"]
    assert sorted(r["id"] for r in M.retained_days(spark.read.parquet(out), today="2024-01-09", days=6).collect()) == ["c", "d"]
    assert M.erase(spark, out, "g 2") and not M.erase(spark, out, "g 2") and stored() == ["a", "b", "c", "d"]
    assert M.without_group(spark.read.parquet(out), "g1").count() == 0
    spark.range(3).selectExpr("id", "concat('2024-01-0', id + 1) as day").write.partitionBy("day").parquet(f"{tmp_path}/days")
    assert M.expire(spark, f"{tmp_path}/days", before="2024-01-03") == 2 and [r["id"] for r in spark.read.parquet(f"{tmp_path}/days").collect()] == [2]


def test_broken_shards_are_listed_and_counted(spark, tmp_path):
    whole = gzip.compress(json.dumps([{"id": str(k), "content": "x" * 50} for k in range(5000)]).encode())
    (tmp_path / "g").mkdir()
    (tmp_path / "g/2024-01-01.json.gz").write_bytes(whole)
    (tmp_path / "g/2024-01-02.json.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "g/2024-01-03.json.gz").write_bytes(b"\x1f\x8bnot compressed at all")
    (tmp_path / "g/2024-01-04.json").write_text('[{"id": "1"}, {"id"')
    (tmp_path / "g/2024-01-05.json").write_bytes(b"[\xff]")
    assert M.read_shards(spark, str(tmp_path)).count() == 5000
    assert sorted(r["path"][-18:].split("/")[-1] for r in M.broken_shards(spark, str(tmp_path)).collect()) == ["2024-01-02.json.gz", "2024-01-03.json.gz", "2024-01-04.json", "2024-01-05.json"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", "props", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    options = dict(key=["event_type", "props"], order="event_id", ts="ts", sender="user_id", cooldown_s=86400)
    source = f"{tmp_path}/in"
    parts = sorted(r[0] for r in events.select("ts").collect())
    middle = F.lit(parts[len(parts) // 2])
    events.filter(F.col("ts") < middle).coalesce(1).write.parquet(f"{source}/a")
    stream = lambda: spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(source)
    stream_verdicts(stream(), f"{tmp_path}/h", f"{tmp_path}/o", f"{tmp_path}/c", **options).awaitTermination()
    events.filter(F.col("ts") >= middle).coalesce(1).write.parquet(f"{source}/b")
    stream_verdicts(stream(), f"{tmp_path}/h", f"{tmp_path}/o", f"{tmp_path}/c", **options).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/h").select("day").distinct().count() > 20
    got = spark.read.parquet(f"{tmp_path}/o").drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, repeats.repeat_verdicts(events, **options).select(*got.columns).collect()))
