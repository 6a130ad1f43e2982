"""Queries against SQL or brute force, and nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import io
import math
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echotrace.llm import chat, common, decontaminate, language, language_model, mixing, quality, queries, shingle_join, spotsigs, templates, token_files, url_rules

SF = "/root/testdata/sf0.001"
TOKENIZER = "word_bpe_49k.json"
ODD = [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, "word", "en", "s"), (4, "word", "en", "s"), (5, "the cat sat on the mat " * 4000, "en", None), (None, "Zoë 😀 the cat sat on the mat " * 3, "fr", "t"), (6, "12 34 !!", None, "t")]
SCHEMA = "doc_id long, text string, lang string, source string"
#: names that the operators use inside
CLASHING = [
    "size", "row", "score", "class", "statistics", "rejected", "n_shingles", "needs", "lang_pred", "target", "source_size", "rounds", "slots", "slot", "number", "block", "leader", "least", "root", "tile", "item_id", "times", "none", "_take", "_slot", "_round", "_rest", "_id", "_class", "bucket", "held_out", "start", "n_tokens",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_words_and_shingles():
    texts = ["A b\tC", None, "", " x ", "é\xa0É  q"]
    data, starts, ends, first = common.word_spans(pa.array(texts))
    got = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    h, at = common.shingles(*common.word_hashes(pa.array(["a b c d", "A B C", "a b", "b a", ""])), 3)
    assert np.diff(at).tolist() == [2, 1, 1, 1, 0] and h[0] == h[2] and len(set(h.tolist())) == 4
    sliced = pa.array(["zz", "a b", "c"]).slice(1)
    assert common.word_hashes(sliced)[0].tolist() == common.word_hashes(pa.array(["a b", "c"]))[0].tolist()


def test_hashing_holds_little_at_once():
    """A batch of 4 MB, as Arrow hands it to tasks."""
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 9000, 700)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    docs = MagicMock()
    docs.schema.fields = []
    shingle_join.with_class(docs, 5, Fraction(4, 5))
    shingle_join._tiles(docs, 5, Fraction(4, 5))
    for call in docs.mapInArrow.call_args_list:
        tracemalloc.start()
        assert sum(1 for _ in call.args[0](iter([batch]))) > 1
        assert tracemalloc.get_traced_memory()[1] < 80e6
        tracemalloc.stop()
    held = sum(x.nbytes for x in common._power(600_000))
    assert held == sum(x.nbytes for x in common._power(500_000)) < 12e6


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([(1, "the cat sat on the mat the cat"), (2, None), (3, ""), (4, "word"), (1, "the cat sat on the mat the cat")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, items).filter("doc_id is not null").collect())
    assert got == [(4, 4), (4, 4), (5, 1), (5, 1)]
    assert decontaminate.find_leaks(odd, items.limit(0)).count() == decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.without_leaks(odd, items).columns == odd.columns


def test_decontaminate_in_slices(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(tuple(r) for r in decontaminate.find_leaks(docs, items).collect())
    kept = decontaminate.without_leaks(docs, items).count()
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 3000)
    assert whole and sorted(tuple(r) for r in decontaminate.find_leaks(docs, items).collect()) == whole
    assert decontaminate.without_leaks(docs, items).count() == kept == docs.count() - len({r[0] for r in whole})


def test_decontaminate_inside_a_long_document(spark):
    draw = np.random.default_rng(1)
    words = [f"w{x}" for x in draw.integers(0, 5000, 30_000)]
    item = [f"q{k}" for k in range(40)]
    words[17_003:17_003] = item
    words[5_000:5_000] = [*item[:20], "other"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:17_000]))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["n_shared"]) for r in decontaminate.find_leaks(docs, items).collect()] == [(1, 36)]


def _tokenizer():
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def test_token_files(spark, docs, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(_tokenizer())
    for table in (docs.select("doc_id", "text"), odd):
        rows = sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        start, want = 0, []
        for i, t in rows:
            ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = [tuple(r) for r in token_files.read_tokens(token_files.write_tokens(table, _tokenizer())).orderBy("start").collect()]
        assert got == want
    assert token_files.read_tokens(token_files.write_tokens(none, _tokenizer())).count() == 0
    manifest = token_files.write_tokens(docs, _tokenizer())
    wanted = docs.select("doc_id").filter("doc_id % 9 = 0").unionByName(spark.createDataFrame([(-5,), (None,)], "doc_id long"))
    found = {r["doc_id"]: r["ids"] for r in token_files.read_documents(manifest, wanted).collect()}
    assert found == {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.filter("doc_id % 9 = 0").collect()}


def test_shards_open_only_what_is_asked_and_notice_damage():
    writer = token_files.ShardWriter(2)
    want = [(k, np.arange(k * 50_000 % 70_000, dtype=np.uint32) % 60_000) for k in range(12)]
    for k, ids in want:
        writer.add(k, ids)
    data = bytearray(writer.close())
    reader = token_files.ShardReader(io.BytesIO(data))
    assert len(reader.table) == 3
    for (k, ids), (i, got) in zip(want, reader.documents(), strict=True):
        assert k == i and (ids == got).all()
    data[20] ^= 1
    reader = token_files.ShardReader(io.BytesIO(data))
    assert next(reader.documents([11]))[0] == 11
    with pytest.raises(Exception):
        list(reader.documents([1]))


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_words_encode_like_whole_texts(text):
    if not hasattr(test_words_encode_like_whole_texts, "encoder"):
        test_words_encode_like_whole_texts.encoder = token_files.WordEncoder(_tokenizer())
    encoder = test_words_encode_like_whole_texts.encoder
    assert encoder(pa.array([text]))[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_and_tells_words_of_one_hash_apart(monkeypatch):
    draw = np.random.default_rng(8)
    texts = [" ".join(f"W{x}é" for x in draw.integers(0, 400, n)) for n in draw.integers(0, 300, 60)] + [None, "", "<|endoftext|> <|ENDOFTEXT|>"]
    for bits in (64, 6):
        monkeypatch.setattr(token_files, "span_hashes", lambda *a, **k: common.span_hashes(*a, **k) >> np.uint64(64 - bits))  # noqa: B023
        encoder = token_files.WordEncoder(_tokenizer(), cached=100)
        for k in range(0, len(texts), 7):
            some = texts[k : k + 7]
            ids, at = encoder(pa.array(some, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
        assert len(encoder.hashes) <= 100 + 7 * 300


def test_language_model(spark, docs, odd, none):
    got = {r["doc_id"]: r for r in language_model.op3_language_model(spark, SF).collect()}
    counts, tokens = Counter(), {}
    for i, t in docs.select("doc_id", "text").collect():
        tokens[i] = [*(t or "").encode().lower().split(), b"\n"]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in language_model.score_documents(odd, odd).collect())
    assert language_model.score_documents(odd, none).count() == len(ODD) and language_model.score_documents(none, odd).count() == 0


def test_scores_equal_a_loop_over_tokens():
    """One token after the other, with whole softmaxes."""
    L = language_model  # noqa: N806
    draw = np.random.default_rng(11)
    head = np.sort(draw.integers(1, 1 << 60, 40))
    head[7] = L.END
    model = L.Model(head, np.arange(40.0, 0, -1), np.full(L.TAIL_CLASSES, 9.0), np.full(L.TAIL_CLASSES, 5.0))
    for w in model.p.values():
        w += draw.standard_normal(w.shape).astype(np.float32) * 0.3
    first = np.array([0, 0, 5, 6, 40, 41])
    x = draw.integers(0, 40 + L.TAIL_CLASSES, 41)
    sigmoid, softmax = (lambda v: 1 / (1 + np.exp(-v))), (lambda v: np.exp(v) / np.exp(v).sum())
    p, n = {k: v.astype(float) for k, v in model.p.items()}, L.HIDDEN
    end = int(model.encode(np.array([L.END]), np.array([0]))[0])
    for row, (a, b) in enumerate(zip(first, first[1:])):
        h, last, total = np.zeros(n), end, 0.0
        for y in x[a:b].tolist():
            i, u = p["x"][last], h @ p["u"]
            r, z = sigmoid(i[:n] + u[:n]), sigmoid(i[n : 2 * n] + u[n : 2 * n])
            new = np.tanh(i[2 * n :] + r * u[2 * n :])
            h = (1 - z) * new + z * h
            kind = y // model.words if y < 40 else L.HEAD_CLASSES + y - 40
            total += np.log10(softmax(h @ p["c"] + p["cb"])[kind])
            if y < 40:
                total += np.log10(softmax(h @ p["w"][kind] + p["wb"][kind])[y % model.words])
            last = y
        assert math.isclose(model.score(x, first)[row], total, rel_tol=1e-4, abs_tol=1e-6)


def test_common_tokens(spark):
    rows = [(k, 0, n) for k, n in enumerate([100, 90, 50, 50, 20, *[3] * 50, *[1] * 2000])]
    counts = spark.createDataFrame(rows, "token long, kind long, n long")
    for most in (0, 1, 4, 5, 30, 55, 500, 5000):
        got = sorted((r["n"] for r in language_model.common_tokens(counts, most).collect()), reverse=True)
        want = sorted((r[2] for r in rows), reverse=True)[: len(got)]
        assert got == want and len(got) <= most and (len(got) >= min(most, 2055) - 12)


def test_language_model_is_a_distribution_and_learns():
    model = language_model.Model(np.array([5, 7, int(language_model.END)]), np.array([3.0, 2, 2]), np.full(language_model.TAIL_CLASSES, 4.0), np.full(language_model.TAIL_CLASSES, 3.0))
    y = np.arange(3 + language_model.TAIL_CLASSES)
    h = np.random.default_rng(0).standard_normal((1, language_model.HIDDEN)).astype(np.float32)
    assert math.isclose(np.exp(model.log_probs(np.repeat(h, len(y), 0), y)).sum(), 1, rel_tol=1e-4)
    x = np.tile([0, 1, 0, 0, 1, 2], 20_000)
    first = np.arange(0, len(x) + 1, 6)
    before = model.score(x, first).sum()
    grads, _ = model._gradients(np.zeros((4, language_model.LANES), int), np.ones((4, language_model.LANES), int), np.zeros((4, language_model.LANES), bool), np.zeros((language_model.LANES, language_model.HIDDEN), np.float32))
    loss = lambda: model.score(np.array([1]), np.array([0, 1]))
    assert set(grads) == set(model.p) and loss() < 0
    model.train(x, first)
    assert model.score(x, first).sum() > before / 2


def test_language_model_learns_from_all_training_documents(spark, docs, none, monkeypatch):
    monkeypatch.setattr(language_model, "SAMPLE_TOKENS", 0)
    turn = "red green blue black white grey pink brown " * 60
    rows = [(k, turn[: 2000 + k], "en", "s") for k in range(400)] + [(None, turn, "en", "s"), (401, None, "en", "s"), (402, "", "en", "s")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    scored = language_model.score_documents(table, table).filter("n_tokens > 9").collect()
    assert sum(r["score"] for r in scored) > 0.5 * sum(r["base_score"] for r in scored)
    token = np.array([5, 7, int(language_model.END)])
    for known, n in ((table, sum(len((r[1] or "").split()) + 1 for r in rows)), (docs, sum(len(r[0].split()) + 1 for r in docs.select("text").collect())), (none, 0)):
        model = language_model.Model(token, np.array([3.0, 2, 2]), np.full(language_model.TAIL_CLASSES, 4.0), np.full(language_model.TAIL_CLASSES, 3.0))
        assert language_model.learn_all(model, language_model.Adam(model.p), known) == n
        assert all(np.isfinite(x).all() for x in model.p.values())


def test_language_model_reads_once_and_keeps_gates_apart(monkeypatch):
    calls, spans = [], common.word_spans
    for module in (common, language_model):
        monkeypatch.setattr(module, "word_spans", lambda text: calls.append(len(text)) or spans(text))
    token, _, first = language_model._read(pa.array(["a B", None, "b a"]))
    assert calls == [3] and first.tolist() == [0, 3, 4, 7] and token[0] == token[5] and token[1] == token[4]
    model = language_model.Model(np.array([5, 7, int(language_model.END)]), np.array([3.0, 2, 2]), np.full(language_model.TAIL_CLASSES, 4.0), np.full(language_model.TAIL_CLASSES, 3.0))
    gates = model.step(np.array([0, 1, 2, 9]), np.zeros((4, language_model.HIDDEN), np.float32))
    assert all(x.flags.c_contiguous and x.shape == (4, language_model.HIDDEN) for x in gates)


def test_gradients_match_differences():
    model = language_model.Model(np.array([5, 7, int(language_model.END)]), np.array([3.0, 2, 2]), np.full(language_model.TAIL_CLASSES, 4.0), np.full(language_model.TAIL_CLASSES, 3.0))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    draw = np.random.default_rng(2)
    shape = 5, language_model.LANES
    came, y, fresh = draw.integers(0, 20, shape), draw.integers(0, 20, shape), draw.random(shape) < 0.2
    h0 = draw.standard_normal((language_model.LANES, language_model.HIDDEN))

    def loss():
        h, total = h0, 0.0
        for t in range(shape[0]):
            h = np.where(fresh[t][:, None], 0, h)
            h = model.step(came[t], h)[0]
            total -= model.log_probs(h, y[t]).sum()
        return total / y.size

    grads, _ = model._gradients(came, y, fresh, h0)
    for name in model.p:
        flat, g = model.p[name].reshape(-1), grads[name].reshape(-1)
        for k in np.argsort(-abs(g))[:3]:
            keep, e = flat[k], 1e-5
            flat[k] = keep + e
            up = loss()
            flat[k] = keep - e
            down = loss()
            flat[k] = keep
            assert math.isclose((up - down) / (2 * e), g[k], rel_tol=2e-3, abs_tol=1e-7), name


def test_mixing_equals_a_loop_over_slots(spark, docs):
    from decimal import Decimal

    from pyspark.sql import functions as F

    rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split()), r["draw"]) for r in docs.select("doc_id", "source", "text", F.xxhash64("doc_id", F.lit(4)).alias("draw")).collect()]
    names = sorted({r[1] for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r[2] for r in rows if r[1] == x) for x in names]
    goal, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes), set(names)
    weight, size = {x: (3, 1, 2)[k % 3] for k, x in enumerate(names)}, dict(zip(names, sizes))
    while open_ and (full := [x for x in open_ if left * weight[x] / sum(weight[y] for y in open_) > 2 * size[x]]):
        for x in full:
            goal[x] = 2.0 * size[x]
            left -= goal[x]
        open_ -= set(full)
    for x in open_:
        goal[x] = left * weight[x] / sum(weight[y] for y in open_)
    n, total = mixing.BLOCK_WORDS, sum(goal.values())
    words = {x: [r[0] for r in sorted((r for r in rows if r[1] == x and r[2]), key=lambda r: r[3]) for _ in range(r[2])] for x in names}  # each word's document
    blocks = {x: [words[x][k : k + n] for k in range(0, len(words[x]), n)] for x in names}
    upto = {x: [0, *np.cumsum([len(b) for b in blocks[x] * 2]).tolist()] for x in names}
    wanted = {x: min(range(1, 2 * len(blocks[x]) + 1), key=lambda k: abs(upto[x][k] - goal[x])) for x in names}  # noqa: B023
    phi, taken, order, rank = (Decimal(5).sqrt() + 1) / 2, Counter(), [], Counter()
    for j in range(math.ceil(total / n)):
        point, edge = ((j + Decimal("0.5")) / phi) % 1, 0.0
        for x in names:
            edge += goal[x] / total
            if point < edge or x == names[-1]:
                break
        if rank[x] < wanted[x]:
            order.append(x)
        rank[x] += 1
    for x in names:
        for k in range(wanted[x]):
            taken.update(blocks[x][k % len(blocks[x])])
    got = {r["doc_id"]: r for r in mixing.op4_mixing(spark, SF).collect()}
    assert {i: r["taken"] for i, r in got.items() if r["taken"]} == dict(taken)
    assert all(math.isclose(r["target"], goal[r["source"]]) and r["source_size"] == size[r["source"]] for r in got.values())
    slots = mixing.schedule(mixing.plan_sources(mixing.with_sizes(docs))).filter(F.col("slot") < math.ceil(total / n)).orderBy("slot").collect()
    assert [names[r["number"]] for r in slots] == order
    assert all(abs(sum(r["taken"] for r in got.values() if r["source"] == x) - goal[x]) <= 2 * n for x in names)


def test_mix_comes_in_order_of_the_schedule(spark, docs):
    mixed, _ = mixing.mix_sources(mixing.with_sizes(docs))
    want = sorted((s, r["row"], r["doc_id"]) for r in mixed.select("row", "doc_id", "rounds", "slots").collect() for n, s in zip(r["rounds"], r["slots"]) if n)
    taken = common.save(mixing.take_mix(mixed, docs.columns), "taken")
    assert [r["doc_id"] for r in token_files.read_tokens(token_files.write_tokens(taken, _tokenizer(), in_file_order=True)).orderBy("start").collect()] == [i for _, _, i in want]


def test_small_sources_are_taken(spark):
    rows = [(k, f"s{k % 300:03d}", "a b c d e f g") for k in range(600)] + [(1000, "big", "w " * 9000)]
    mixed, _ = mixing.mix_sources(mixing.with_sizes(spark.createDataFrame(rows, "doc_id long, source string, text string")))
    by = {r["source"]: r["taken"] for r in mixed.selectExpr("source", "rounds[0] + rounds[1] as t").groupBy("source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "taken").collect()}
    assert len(by) == 301 and all(n > 0 for n in by.values())
    # a source's last block is as long as it is: targets are met to within half a block
    rows = [(10 * k + n, f"s{k}", "w " * (size // 2 if n else size - size // 2)) for k, size in enumerate((10, 40, 65, 70, 129, 1000)) for n in (0, 1)]
    mixed, sources = mixing.mix_sources(mixing.with_sizes(spark.createDataFrame(rows, "doc_id long, source string, text string")), weights=(3.0, 3.0, 3.0, 3.0, 3.0, 1.0))
    by = {r["source"]: r["taken"] for r in mixed.selectExpr("source", "rounds[0] + rounds[1] as t").groupBy("source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "taken").collect()}
    goal = {r["source"]: r["target"] for r in sources.collect()}
    assert [goal[f"s{k}"] for k in range(5)] == [20, 80, 130, 140, 258] and all(abs(by[x] - goal[x]) <= mixing.BLOCK_WORDS / 2 for x in goal)


@pytest.mark.parametrize("words", [1, 10, 63, 64, 65, 130, 700])
def test_blocks_wanted_come_nearest(words):
    blocks = -(-words // 64)
    upto = [0, *np.cumsum([min(64, words - 64 * k) for k in range(blocks)] * 2).tolist()]
    for target in np.linspace(0, 2 * words, 57):
        k = mixing.blocks_wanted(float(target), words, blocks)
        assert 1 <= k <= 2 * blocks and abs(upto[k] - target) <= min(abs(x - target) for x in upto[1:]) + 1e-9


def test_mixing(spark, docs, odd, none):
    rows = [r for r in mixing.op4_mixing(spark, SF).collect()]
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in mixing.op4_mixing(spark, SF).collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        t[1] += r["taken"]
    assert all(abs(taken - target) <= max(0.05 * target, 4 * mixing.BLOCK_WORDS) for target, taken, _ in by.values())
    assert math.isclose(sum(t for t, _, _ in by.values()), 1.5 * sum(s for _, _, s in by.values()))
    mixed, _ = mixing.mix_sources(mixing.with_sizes(odd))
    assert mixed.count() == len(ODD)
    total = sum(len(r["text"].split()) for r in mixing.take_mix(mixed, odd.columns).collect())
    assert total == sum(sum(r["rounds"]) for r in mixed.collect())
    assert mixing.mix_sources(mixing.with_sizes(none))[0].count() == 0
    assert mixing.targets([10, 100], [3, 1]) == [20.0, 145.0]


def test_templates():
    render = templates.compile_template("{% for m in messages %}{% if loop.first %}[{% elif not loop.last and m.role == 'b' %}b{{ m.text | up }}{% else %}{{ 'x' + 'y' }}{% endif %}{% endfor %}]", {"up": str.upper})
    assert "".join(p for p, _ in render(iter([{"role": "a", "text": "q"}, {"role": "b", "text": "w"}, {"role": "c", "text": "e"}]))) == "[bWxy]"
    for bad in ("{{ a.__class__ }}", "{{ f(x) }}", "{% for x in y %}", "{{ x | nope }}", "{% endif %}", "{{ 'a }}", "{{ a b }}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(bad)
    assert templates._fold_nodes(templates._parse("a{% if 'x' == 'x' %}b{{ 'c' }}{% else %}d{% endif %}"), {}) == [("text", "abc")]


@given(st.text(alphabet="\\<>lgn/turn x\n", max_size=40))
def test_escapes_can_be_undone(text):
    for escaped in (chat.escape(text), chat.escape_role(text)):
        assert chat.unescape(escaped) == text and "<" not in escaped


def test_chat(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "us\ner>", "</turn>\n<turn assistant>\nhi"), (None, 0, None, "x"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, None, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    text = "us\ner>\n</turn>\n<turn assistant>\nhi\nassistant\n\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 0
    assert got[2]["loss_sha256"] == hashlib.sha256(b"aa").hexdigest() and got[2]["n_turns"] == 2 and got[None]["n_turns"] == got[3]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def test_urls(spark):
    urls = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/en/7x?y"), (3, "HTTP://A.Example.COM/en/7x?y"), (4, "x://net/de/8"), (5, "x://example.net/de/8"), (6, "x://badcom/en/"), (7, "x://com"), (8, "x://" + "a." * 3000 + "org/es/" + "z" * 50_000), (None, "x://org/es/#")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = url_rules.rules_frame(spark, url_rules.RULES)
    got = sorted(((r["page_id"] or 0, r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, rules).collect()), key=str)
    want = [(0, "org/es/", "block"), (1, None, "allow"), (2, None, "allow"), (3, "example.com/en/7", "allow"), (3, "example.com/en/7", "allow"), (4, "net/de/", "allow"), (5, "example.net/de/8", "block"), (6, None, "allow"), (7, None, "allow"), (8, "org/es/", "block")]
    assert got == sorted(want, key=str)
    assert url_rules.judge_urls(pages, rules.limit(0)).filter("rule is null and verdict = 'allow'").count() == len(urls) and url_rules.judge_urls(pages.limit(0), rules).count() == 0


def test_quality(spark, odd, none):
    big = "/root/testdata/sf0.01"
    scores = quality.op7_quality(spark, big)
    held = scores.filter("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").select("quality", "predicted", "score").collect()
    assert sum(r["quality"] == r["predicted"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in held)
    labels = spark.createDataFrame([(4, 1), (4, None), (5, 0)], "doc_id long, quality int")
    measured = quality.with_statistics(odd)
    for known in (labels, labels.limit(0)):
        assert quality.score(measured, quality.fit(measured, known)).count() == len(ODD)
    assert quality.score(quality.with_statistics(none), quality.fit(measured, labels.limit(0))).count() == 0
    x, y = quality.isotonic(np.arange(4.0), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3]


def test_quality_equals_a_closed_form(spark, docs):
    labels = [(r["doc_id"], float(r["quality"])) for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null").collect()]
    measured = quality.with_statistics(docs.select("doc_id", "text"))
    scorer = quality.fit(measured, spark.createDataFrame(labels, "doc_id long, quality double"))
    from pyspark.sql import functions as F

    side = {r["doc_id"]: r["a"] for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(78)), F.lit(4)) == 0).alias("a")).collect()}
    x = {r["doc_id"]: np.array(r["statistics"], float) for r in measured.collect()}
    rows = np.array([x[i] for i, _ in labels if i in x])
    y, aside = np.array([v for i, v in labels if i in x]), np.array([side[i] for i, _ in labels if i in x])
    z = np.clip((rows - rows.mean(0)) / np.where(rows.std(0) > 1e-9, rows.std(0), 1), -6, 6)
    features = np.array([[math.sqrt(2 / quality.FEATURES) * math.cos(sum(a * b for a, b in zip(r, scorer.frequencies[:, k])) + scorer.phases[k]) for k in range(quality.FEATURES)] + [1.0] for r in z])
    seen = features[~aside]
    # ridge as least squares with rows for the penalty
    weights = np.linalg.lstsq(np.vstack([seen, math.sqrt(quality.RIDGE) * np.eye(seen.shape[1])]), np.concatenate([y[~aside], np.zeros(seen.shape[1])]), rcond=None)[0]
    raw = features @ weights
    assert np.allclose(raw, [scorer.raw(x[i][None])[0] for i, _ in labels if i in x], atol=1e-6)
    assert (np.diff(scorer.steps[1]) > 0).all() and (np.diff(scorer.scores(rows[np.argsort(raw)])) >= -1e-12).all()


def test_kernel_accuracy():
    draw = np.random.default_rng(1)
    scorer = quality.Scorer(np.zeros(4), np.ones(4))
    x, y = draw.standard_normal((2, 50, 4)) * 0.5
    near = (scorer.features(x)[:, :-1] * scorer.features(y)[:, :-1]).sum(1)
    assert np.abs(near - np.exp(-((x - y) ** 2).sum(1) / 4)).mean() < 0.1


def test_spotsigs(spark, docs, odd, none):
    for table in (docs.select("doc_id", "text"), odd.filter("doc_id <> 4 or doc_id is null")):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        got = {r["doc_id"]: r for r in spotsigs.compare_with_next(table).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            a, b, c = spotsigs.spot_sets([t, edited, after])
            r = got[i]
            assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.as_text(a), spotsigs.as_text(b))
            jaccard = lambda p, q: len(set(p.tolist()) & set(q.tolist())) / len(set(p.tolist()) | set(q.tolist())) if len(p) or len(q) else 1.0
            assert all(math.isclose(got_, want_, abs_tol=1e-12) for got_, want_ in ((r["near_edited"], jaccard(a, b)), (r["near_next"], jaccard(a, c)))) and spotsigs.likeness(a, b) == r["near_edited"]
    assert spotsigs.compare_with_next(odd).count() == len(ODD) and spotsigs.compare_with_next(none).count() == 0
    prints = {r["doc_id"]: set(r["spots"]) for r in spotsigs.fingerprints(docs).collect()}
    classes = {}
    for i, s in prints.items():
        if s:
            classes[frozenset(s)] = min(i, classes.get(frozenset(s), i))
    ids = sorted((i, s) for s, i in classes.items())
    want = {(a, b) for k, (a, s) in enumerate(ids) for b, t in ids[k + 1 :] if len(s & t) >= 0.8 * len(s | t)}
    assert {(r["a"], r["b"]) for r in spotsigs.matches(spotsigs.fingerprints(docs)).collect()} == want


def test_spotsigs_hash_few_bytes_at_once():
    """Runs are cut by bytes, not by characters; every document is in one, with the next after it."""
    sizes = [90_000] * 40 + [3_000_000] + [9] * 300
    rows = [((k // 150, False, k), n) for k, n in enumerate(sizes)]
    rows[300:300] = [((1, True, 300), 9)]
    rows[150:150] = [((0, True, 150), 9), ((0, True, 150), 9)]
    got = list(spotsigs.runs(iter(rows)))
    assert [x[2] for run in got for x in run[:-1]] == list(range(len(sizes) - 1))
    assert all(b[2] == a[2] + 1 for run in got for a, b in zip(run, run[1:]))
    assert all(sum(sizes[x[2]] for x in run) <= common.HASHED_BYTES for run in got if all(x[2] != 40 for x in run))


def test_signatures_without_ids_are_matched(spark):
    words = [f"the w{k} x{k} y{k} a z{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join(words)), (3, " ".join([*words[:-2], "the new end of it"])), (4, "a thing apart " * 9), (None, None)]
    got = spotsigs.matches(spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == 1 and (got[0]["a"], got[0]["b"]) == (None, 3) and 0.8 <= got[0]["likeness"] < 1


def test_spotsigs_cover_texts_without_bare_common_words():
    draw = np.random.default_rng(4)
    made = [" | ".join(f"c{x}" for x in draw.integers(0, 900, 200)), " ".join(f"{w}&&& j{x}%%%" for w, x in zip(["the", "de"] * 100, draw.integers(0, 900, 200))), " ".join(f"THE.!! W{x}!!" for x in draw.integers(0, 900, 200))]
    made.append(" ".join("".join(chr(0x430 + y) for y in draw.integers(0, 32, 6)) for _ in range(300)))
    for text in made:
        words = text.split()
        other = words[: len(words) // 2] + [f"{w}q" for w in words[len(words) // 2 :]]
        a, b, c = spotsigs.spot_sets([text, " ".join(other), " ".join(words[:-3] + ["q1", "q2", "q3"])])
        assert len(a) >= len(words) / 8
        assert 0.2 < spotsigs.likeness(a, b) < 0.5 and 0.9 < spotsigs.likeness(a, c) < 1
    sets = spotsigs.spot_sets(["x y z", "x y w", "", "x", "%% !", "the"])
    assert sets[0].tolist() != sets[1].tolist() and [len(x) > 0 for x in sets] == [True, True, False, True, True, True]
    assert [x.tolist() for x in sets] == [spotsigs.spot_sets([t])[0].tolist() for t in ["x y z", "x y w", "", "x", "%% !", "the"]]


def test_every_language_is_learnt(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(100 + k % 7)}ot {chr(98 + k % 24)}uri " * 20, f"l{k:02d}", "s") for k in range(30)] + [(100 + k, "the cat sat on the mat " * 9, "en", "s") for k in range(20)] + [(None, "the dog", "en", "s")] * 5 + [(200, " ", "l00", "s")]
    table = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(table)
    assert sorted(model.langs) == sorted({r[2] for r in rows})
    told = {r["doc_id"]: r["lang_pred"] for r in language.identify(table, model).collect()}
    assert sum(told[k] == f"l{k:02d}" for k in range(30)) >= 28


def test_language(spark, odd, none):
    big = "/root/testdata/sf0.01"
    held = language.op9_language_id(spark, big).filter("held_out").join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and sum(r["rejected"] for r in held) <= 0.02 * len(held)
    judged = language.identify(odd, language.fit(odd)).collect()
    assert len(judged) == len(ODD) and all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in judged if r["doc_id"] in (1, 2, 3, 6))
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(none)).collect()} == {"und"}
    assert language.identify(none, language.fit(odd)).count() == 0


def test_language_models_sum_to_one(docs):
    import pandas as pd

    texts = ["abc abd", "bca"]
    s, at = language.symbols(texts)
    places = language._places(at)
    counts = pd.DataFrame({**{f"c{j}": s[places + j] for j in range(4)}, "lang": "x", "n": 1}).groupby(["lang", "c0", "c1", "c2", "c3"], as_index=False)["n"].sum()
    model = language.Model(counts)
    seen = np.unique(s)
    for context in ([0, 0, 0], [0, 97, 98], [5, 6, 7]):
        p = 2.0 ** model._score([*(np.full(len(seen), c) for c in context), seen], 4)
        rest = 2.0 ** model._score([np.array([c]) for c in [*context, 9999]], 4)
        assert math.isclose(p.sum() + rest.sum(), 1, rel_tol=1e-4)


def test_language_models_equal_dictionaries():
    import pandas as pd

    texts = {"x": ["abc abd", "bca ab"], "y": ["abab cd"]}
    frames = []
    for lang, own in texts.items():
        s, at = language.symbols(own)
        places = language._places(at)
        frames.append(pd.DataFrame({**{f"c{j}": s[places + j] for j in range(4)}, "lang": lang, "n": 1}).groupby(["lang", "c0", "c1", "c2", "c3"], as_index=False)["n"].sum())
    counts = pd.concat(frames)
    model = language.Model(counts)
    alphabet = len(set(counts["c3"])) + 1
    for k, lang in enumerate(model.langs):
        tables = {4: Counter({tuple(int(r[f"c{j}"]) for j in range(4)): int(r["n"]) for _, r in counts[counts["lang"] == lang].iterrows()})}
        for order in (3, 2, 1):  # below the top, how many different symbols came before
            tables[order] = Counter(g[1:] for g in tables[order + 1])

        def p(gram):
            if not gram:
                return 1 / alphabet
            table = tables[len(gram)]
            once, twice = (sum(c == x for c in table.values()) for x in (1, 2))
            d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            own = [c for g, c in table.items() if g[:-1] == gram[:-1]]
            if not own:
                return p(gram[1:])
            return max(table[gram] - d, 0) / sum(own) + d * len(own) / sum(own) * p(gram[1:])  # noqa: B023

        for gram in [*tables[4], (0, 0, 0, 100), (97, 98, 99, 97), (97, 98, 0, 100), (1, 2, 3, 97), (1, 2, 97, 98)]:
            got = 2.0 ** model._score([np.array([c]) for c in gram], 4)[0, k]
            assert math.isclose(got, p(gram), rel_tol=1e-4), (lang, gram)


def _components(table, words, threshold):
    rows = table.select("doc_id", "text").collect()
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def test_shingle_join(spark, docs, odd, none):
    draw = np.random.default_rng(5)
    base = [f"w{x}" for x in draw.integers(0, 300, 120)]
    rows = []
    for k in range(150):
        own = list(base)
        for at in draw.integers(0, len(own), draw.integers(0, 9)):
            own[at] = f"z{draw.integers(0, 40)}"
        rows.append((1000 + k, " ".join(own[: 120 - int(draw.integers(0, 12))])))
    rows += [(2000 + k, f"w{k} w{k % 3}") for k in range(9)] + [(3000, "a b c d e f g h i j"), (3001, "a b c d e f g h i j k")]
    near = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for words, threshold in ((3, Fraction(9, 10)), (5, Fraction(4, 5)), (3, Fraction(1, 2))):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_join.shingle_components(near, words=words, threshold=threshold).collect())
        assert got == _components(near, words, threshold)
    assert shingle_join.shingle_components(odd, words=5, threshold=Fraction(4, 5)).count() == len(ODD)
    assert sorted(r["doc_id"] for r in shingle_join.keep_one(odd).filter("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6]
    assert shingle_join.keep_one(none).count() == 0


def test_shingle_join_links_rows_without_an_id(spark):
    base = [f"w{k}" for k in range(60)]
    change = lambda *at: " ".join(f"x{k}" if k in at else w for k, w in enumerate(base))
    bridge = [(None, change(0, 1)), (1, change()), (2, change(0, 1, 58, 59))]  # 1 and 2 link through the row without an id alone
    apart = [(None, " ".join(f"y{k}" for k in range(50))), (None, " ".join(f"y{k}" for k in range(51))), (None, " ".join(f"y{k}" for k in range(51)))]
    table = spark.createDataFrame([*bridge, *apart], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in shingle_join.shingle_components(table, words=3, threshold=Fraction(9, 10)).collect()), key=str)
    assert got == [(1, 1), (2, 1), (None, 1), (None, None), (None, None), (None, None)]
    kept = shingle_join.keep_one(table, words=3, threshold=Fraction(9, 10)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "None"]


def test_near_copies_without_broadcasts_and_with_blocks(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    table = docs.unionByName(docs.limit(9)).withColumn("tag", F.lit("t"))
    known = sorted(r["doc_id"] for r in shingle_join.keep_one(table).collect())
    monkeypatch.setattr(shingle_join, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(shingle_join, "SEEN_CLASSES", 1)
    monkeypatch.setattr(shingle_join, "PAIR_TILE", 1)
    monkeypatch.setattr(shingle_join, "BLOCK_CLASSES", 2)
    monkeypatch.setattr(shingle_join, "LEADERS", 1)
    assert sorted(r["doc_id"] for r in shingle_join.keep_one(table).collect()) == known and len(known) < docs.count()


def test_classes_of_a_link_are_in_as_many_tiles_as_they_need():
    draw = np.random.default_rng(12)
    for threshold in (Fraction(4, 5), Fraction(9, 10), Fraction(1, 2)):
        for n in (3, 8, 20, 90, 400, 1500):
            a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
            most = int(len(a) * (1 - threshold) / (1 + threshold))
            b = np.unique(np.concatenate([a[most:], draw.integers(0, 1 << 63, most).astype(np.uint64)]))
            if not shingle_join.linked(a, b, threshold) or len(a) == len(np.intersect1d(a, b)):
                continue
            values, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            rows, keys = shingle_join.segment_keys(values, first, threshold)
            shared, mask = np.intersect1d(keys[rows == 0], keys[rows == 1]), (1 << shingle_join.BAND_BITS) - 1
            need = [{x & mask: x >> shingle_join.BAND_BITS for x in own} for own in shingle_join.needs(values, first, threshold)]
            band = min(max(need[0]), max(need[1]))
            assert sum(k & mask == band for k in shared.tolist()) >= max(need[0][band], need[1][band]) >= 1


def test_bitmaps_bound_from_above():
    draw = np.random.default_rng(6)
    for n in (3, 40, 700):
        a = np.unique(draw.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], draw.integers(0, 1 << 62, n // 8 + 1).astype(np.uint64)]))
        x, y = shingle_join.bitmap(a), shingle_join.bitmap(b)
        words = min(len(x), len(y), 4)
        apart = int(np.bitwise_count(shingle_join.fold(x, words) ^ shingle_join.fold(y, words)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_clashing_columns(spark, odd):
    """Columns with names that operators use inside come out of every stage as they went in."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    named = {c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING}
    table = odd.withColumn("n_chars", F.length("text")).select("*", *[v.alias(c) for c, v in named.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHING), name
    assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == len(ODD)
    assert shingle_join.shingle_components(table, words=3, threshold=Fraction(9, 10)).count() == len(ODD)
    assert quality.with_statistics(table).count() == len(ODD)


def test_rows_without_a_language_stay(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.identify_language(spark, unlabelled, SF).collect()) == ["4", "4", "5", "None"]


def test_foreign_texts_are_rejected(spark):
    draw = np.random.default_rng(9)
    made = lambda letters, n, size: [" ".join("".join(draw.choice(list(letters), 5)) for _ in range(size)) for _ in range(n)]
    rows = [(k, t, "x") for k, t in enumerate(made("abcdefg", 120, 60))] + [(1000 + k, t, "y") for k, t in enumerate(made("pqrstu", 24, 60))]  # y has few texts to calibrate on
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    asked = spark.createDataFrame([(1, made("abcdefg", 1, 60)[0]), (2, made("pqrstu", 1, 60)[0]), (3, made("hijklmno", 1, 60)[0]), (4, made("жзийклмн", 1, 60)[0])], "doc_id long, text string")
    assert [(r["doc_id"], r["rejected"]) for r in language.identify(asked, model).orderBy("doc_id").collect()] == [(1, False), (2, False), (3, True), (4, True)]
    assert language.identify(docs, model).filter("rejected").count() <= 2


def test_pipeline(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
