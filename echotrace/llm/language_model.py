"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored softmax.

Tokens are words (A-Z lower-cased) and one end.  Spark counts the tokens of all training documents; the counts set the vocabulary
and the base score, add-one unigrams: log10((c + 1) / (N + V + 1)) a token.

The model is a GRU, trained here in numpy by backpropagation truncated to windows of ``WINDOW`` tokens.  A sample (``SAMPLE_TOKENS``
in expectation, whole documents drawn by a hash) gives first weights; then learn_all() learns from every training document.  Its softmax has two levels.  The ``HEAD`` commonest tokens are
dealt by frequency into ``HEAD_CLASSES`` classes with a softmax each; all other words belong to one of ``TAIL_CLASSES`` classes by their
last two bytes and get their add-one share of it, unknown words together the share of a word never seen.  So the model is a
distribution over the V + 1 tokens of the base (with an unknown word a class).  Documents are scored from the first token to the end, with the state carried from window to window.

The log10(c + 1) of a document's words come from a broadcast of the ``KNOWN`` commonest counts and, for all other words, a join
with the table of counts.  Words are told apart by 64-bit hashes.  Null texts count as empty: their end alone is scored.
Rows with the same id are scored separately; without training documents all counts are 0; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import held_out, pieces, read_table, save, span_hashes, word_spans

HEAD, HEAD_CLASSES, TAIL_CLASSES, HIDDEN = 1024, 32, 32, 32
WINDOW, LANES, SAMPLE_TOKENS, EPOCHS, RATE = 16, 64, 600_000, 2, 0.004
PASS_LANES, ROUNDS, SUMS = 512, 4, 16
KNOWN = 65_536
LONG_BYTES, SCORED_BYTES = 8192, 6 << 20
END = np.int64(-0x0E4D)


def tail_classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A class for each word, from its last two bytes."""
    low = np.arange(256, dtype=np.int64)
    low[65:91] += 32
    last = low[data[ends - 1]]
    before = np.where(ends - starts > 1, low[data[np.maximum(ends - 2, 0)]], 0)
    return (last * 31 + before * 7) % TAIL_CLASSES


def _read(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of all tokens, with an end after each row's words, and where rows begin."""
    data, starts, ends, first = word_spans(text)
    hashes = span_hashes(data, starts, ends)
    n = len(first) - 1
    out = np.full(len(hashes) + n, END)
    kinds = np.zeros(len(out), np.int64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(first))
    out[place] = hashes.view(np.int64)
    if len(starts):
        kinds[place] = tail_classes(data, starts, ends)
    return out, kinds, first + np.arange(n + 1)


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    token, kind, n = (np.concatenate(x) for x in zip(*parts))
    u, at, inverse = np.unique(token, return_index=True, return_inverse=True)
    return u, kind[at], np.bincount(inverse, n, len(u)).astype(np.int64)


def count_tokens(docs: DataFrame, *, text: str = "text", held: int = 1_500_000) -> DataFrame:
    """(token, kind, n) for every distinct token of the documents; tasks sum what they have read before they send it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in pieces(batches):
            token, kind, _ = _read(batch.column(0))
            u, at, n = np.unique(token, return_index=True, return_counts=True)
            parts.append((u, kind[at], n))
            if sum(len(p[0]) for p in parts) > held:
                parts = [_merge(parts)]
                if len(parts[0][0]) > held // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts.pop()], names=["token", "kind", "n"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merge(parts)], names=["token", "kind", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "token long, kind long, n long").groupBy("token").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))


def common_tokens(counts: DataFrame, most: int = KNOWN) -> DataFrame:
    """The commonest of (token, kind, n), as many as ``most`` allows: by a histogram of counts in steps of a hundredth or so, and within the step where
    it runs out by a hash of the token.  No task and not the driver sees more than those."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 64)
    place = F.pmod(F.xxhash64("token"), F.lit(4096))
    left, cut, share = most, None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):  # 64 steps for each doubling
        cut = r["step"]
        if r["n"] > left:
            # of that step's tokens, as many hash places as hold what is left
            places = counts.filter(step == cut).groupBy(place.alias("place")).agg(F.count("*").alias("n")).orderBy("place").collect()  # 4096 rows at most
            for p in places:
                if p["n"] > left:
                    break
                left, share = left - p["n"], p["place"] + 1
            break
        left -= r["n"]
    else:
        return counts
    return counts.filter((step > cut) | ((step == cut) & (place < share)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exp(x: np.ndarray) -> np.ndarray:
    """exp, in place; logits are small (states are within 1, biases at most 0), so that nothing need be taken off for floats' range."""
    np.minimum(x, 80, out=x)
    return np.exp(x, out=x)


@lru_cache
def _ones(n: int, kind: str) -> np.ndarray:
    return np.ones(n, kind)


def _sums(x: np.ndarray) -> np.ndarray:
    """Row sums, as a product: quicker than a sum along short rows."""
    return x @ _ones(x.shape[1], x.dtype.str) + np.finfo(x.dtype).tiny


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    _exp(x)
    x /= _sums(x)[:, None]
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row, the logarithm of the softmax at one place; ``x`` is used up."""
    own = x[np.arange(len(x)), at]
    return own - np.log(_sums(_exp(x)))


class Model:
    """``head``: the commonest tokens with counts, in falling order; ``class_totals``: sum of c + 1 over each tail class's words, one more for an unknown one."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, class_totals: np.ndarray, class_tokens: np.ndarray):
        self.words = -(-max(len(head), 1) // HEAD_CLASSES)  # to a class
        order = np.argsort(head)
        self.sorted, self.rank = head[order], order
        self.log_counts = np.log10(counts + 1.0)
        self.totals = np.log10(class_totals)
        n, classes = len(head), HEAD_CLASSES + TAIL_CLASSES
        draw = np.random.default_rng(3)
        grid = np.zeros(HEAD_CLASSES * self.words)
        grid[:n] = counts + 1.0
        grid = grid.reshape(HEAD_CLASSES, self.words)
        normal = lambda *shape: (draw.standard_normal(shape) * 0.08).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.p = {
                "x": normal(n + TAIL_CLASSES, 3 * HIDDEN), "u": normal(HIDDEN, 3 * HIDDEN), "c": normal(HIDDEN, classes), "w": normal(HEAD_CLASSES, HIDDEN, self.words),
                "cb": np.log(np.concatenate([grid.sum(1) + 1e-9, class_tokens + 1.0])).astype(np.float32), "wb": np.maximum(np.log(grid), -40).astype(np.float32),
            }
        self.p["cb"] -= self.p["cb"].max()
        self.p["wb"] -= self.p["wb"].max(1, keepdims=True)

    def encode(self, token: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Inputs: a head token's rank, or the number of heads plus the tail class."""
        n = len(self.sorted)
        if not n:
            return kind.copy()
        at = np.minimum(np.searchsorted(self.sorted, token), n - 1)
        return np.where(self.sorted[at] == token, self.rank[at], n + kind)

    def _class(self, x: np.ndarray) -> np.ndarray:
        n = len(self.sorted)
        return np.where(x < n, x // self.words, HEAD_CLASSES + x - n)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.gates([self.p["x"][x, k : k + HIDDEN] for k in range(0, 3 * HIDDEN, HIDDEN)], h, self.recurrent())

    def recurrent(self) -> np.ndarray:
        """The recurrent weights of each gate, one after the other: gates are arrays of their own, as numpy is slow on parts of rows."""
        return np.ascontiguousarray(self.p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))

    def gates(self, a: list[np.ndarray] | np.ndarray, h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after ``h`` and the gates' rows ``a`` of the input weights, with what gradients need."""
        r, z, un = np.matmul(h, weights)
        r += a[0]
        z += a[1]
        r, z = _sigmoid(r), _sigmoid(z)
        n = r * un
        n += a[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, r, z, n, un

    def _sorted(self, h: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The places of head tokens in order of their classes, their states, the logits of their classes' words, and which of them each class has."""
        order = np.argsort(c.astype(np.uint8), kind="stable")
        edges = np.searchsorted(c[order], np.arange(HEAD_CLASSES + 1))
        order = order[: edges[-1]]
        parts = [(k, a, b) for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())) if a < b]
        own, w = h[order], self.p["w"]
        logits = np.take(self.p["wb"], c[order], axis=0)
        for k, a, b in parts:
            logits[a:b] += own[a:b] @ w[k]
        return order, own, logits, parts

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithm of what the model says of tokens y after states h; a tail token's share of its class isn't in it."""
        c = self._class(y)
        out = _log_softmax_at(h @ self.p["c"] + self.p["cb"], c)
        order, _, logits, _ = self._sorted(h, y, c)
        out[order] += _log_softmax_at(logits, y[order] % self.words)
        return out

    def score(self, x: np.ndarray, first: np.ndarray, window: int = 1 << 14) -> np.ndarray:
        """log10 probability of each row's tokens, without tail tokens' shares.  Rows run side by side, longest first; states carry over."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        start, length = first[:-1][order], n[order]
        end = self.encode(np.array([END]), np.array([0]))[0]
        total, h = np.zeros(len(n)), np.zeros((len(n), HIDDEN), np.float32)
        last = np.full(len(n), end)
        states, targets, held = [], [], 0
        weights, inputs = self.recurrent(), [np.ascontiguousarray(self.p["x"][:, k : k + HIDDEN]) for k in range(0, 3 * HIDDEN, HIDDEN)]
        for t, live in enumerate(np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left").tolist()):  # rows longer than t
            h[:live] = self.gates([g.take(last[:live], 0) for g in inputs], h[:live], weights)[0]
            last[:live] = x[start[:live] + t]
            states.append(h[:live].copy())
            targets.append(last[:live].copy())
            held += live
            if held >= window or t + 1 == length[0]:
                rows = np.concatenate([np.arange(len(y)) for y in targets])
                total += np.bincount(rows, self.log_probs(np.concatenate(states), np.concatenate(targets)), len(total))
                states, targets, held = [], [], 0
        out = np.empty(len(n))
        out[order] = total / np.log(10)
        return out

    def train(self, x: np.ndarray, first: np.ndarray) -> None:
        """Learn EPOCHS times from a few documents."""
        adam = Adam(self.p)
        for _ in range(EPOCHS):
            self.learn(x, first, adam, LANES)

    def learn(self, x: np.ndarray, first: np.ndarray, adam: Adam, lanes: int) -> None:
        """A step for each window of WINDOW tokens in all lanes, over all tokens; gradients stop at a window's beginning, states don't."""
        if not len(x):
            return
        end = self.encode(np.array([END]), np.array([0]))[0]
        fresh = np.zeros(len(x), bool)
        fresh[first[:-1]] = True
        came = np.concatenate([[end], x[:-1]])  # the token before; at a document's beginning that is an end
        lanes = max(1, min(lanes, len(x) // (64 * WINDOW)))  # few tokens still make some steps
        steps = -(-len(x) // (lanes * WINDOW)) * WINDOW
        cut = lambda a: np.pad(a, (0, steps * lanes - len(a))).reshape(lanes, steps).T
        came, live, x, fresh = cut(came), cut(np.ones(len(x), bool)), cut(x), cut(fresh)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, steps, WINDOW):
            part = slice(t, t + WINDOW)
            grads, h = self._gradients(came[part], x[part], fresh[part], h, live[part])
            adam.step(self.p, grads)

    def _gradients(self, came: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, live: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
        """Of the mean loss of the tokens that are ``live`` (all if None), and the states to go on with."""
        p, kept, states, lanes = self.p, [], [], came.shape[1]
        weights, inputs = self.recurrent(), [np.ascontiguousarray(p["x"][:, k : k + HIDDEN]).take(came, 0) for k in range(0, 3 * HIDDEN, HIDDEN)]
        for t in range(len(came)):
            if fresh[t].any():
                h = np.where(fresh[t][:, None], np.float32(0), h)
            new, r, z, n, un = self.gates([g[t] for g in inputs], h, weights)
            kept.append((h, r, z, n, un))
            states.append(new)
            h = new
        states = np.concatenate(states)
        flat = y.ravel()
        scale = np.float32(1 / len(flat))
        if live is not None and not live.all():
            scale = (live.ravel() / np.float32(max(live.sum(), 1))).astype(np.float32)[:, None]
        c = self._class(flat)
        d = _softmax(states @ p["c"] + p["cb"])
        d[np.arange(len(flat)), c] -= 1
        d *= scale
        g = {"c": states.T @ d, "cb": d.sum(0), "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"]), "x": np.zeros_like(p["x"])}
        dh = d @ p["c"].T
        order, own, e, parts = self._sorted(states, flat, c)
        _softmax(e)
        e[np.arange(len(order)), flat[order] % self.words] -= 1
        e *= scale if np.ndim(scale) == 0 else scale[order]
        back = np.empty_like(own)
        for k, a, b in parts:
            g["w"][k], g["wb"][k] = own[a:b].T @ e[a:b], _ones(b - a, e.dtype.str) @ e[a:b]
            np.matmul(e[a:b], p["w"][k].T, out=back[a:b])
        dh[order] += back
        after = np.zeros((lanes, HIDDEN), p["u"].dtype)
        da, du = np.empty((3, *came.shape, HIDDEN), p["u"].dtype), np.empty((3, *came.shape, HIDDEN), p["u"].dtype)
        turned = np.ascontiguousarray(weights.transpose(0, 2, 1))
        for t in range(len(kept) - 1, -1, -1):
            hp, r, z, n, un = kept[t]
            dt = dh[t * lanes : (t + 1) * lanes] + after
            kept_on = dt * z
            dn = da[2, t]
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dt -= kept_on
            dn *= dt
            ur, uz, un_ = du[0, t], du[1, t], du[2, t]
            np.multiply(dn, r, out=un_)
            np.multiply(un_, un, out=ur)
            ur *= 1 - r
            np.subtract(hp, n, out=uz)
            uz *= kept_on
            uz *= 1 - z
            after = ur @ turned[0]
            after += uz @ turned[1]
            after += un_ @ turned[2]
            after += kept_on
            if fresh[t].any():
                after *= ~fresh[t][:, None]
        da[:2] = du[:2]
        before = np.concatenate([x[0] for x in kept]).T
        g["u"] = np.concatenate([before @ x.reshape(-1, HIDDEN) for x in du], 1)
        order = np.argsort(came.ravel().astype(np.uint16), kind="stable")
        tokens, at = np.unique(came.ravel()[order], return_index=True)
        for k in range(3):
            g["x"][tokens, k * HIDDEN : (k + 1) * HIDDEN] = np.add.reduceat(da[k].reshape(-1, HIDDEN).take(order, 0), at, axis=0)
        return g, h


class Adam:
    """Moments of all weights; a step with gradients cut to norm 1."""

    def __init__(self, p: dict):
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        self.count, self.rate = 0, RATE

    def step(self, p: dict, grads: dict) -> None:
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        self.count += 1
        fit, first, second = np.float32(min(1.0, 1.0 / (norm + 1e-9))), np.float32(self.rate / (1 - 0.9**self.count)), np.float32(1 / (1 - 0.999**self.count))
        for k, g in grads.items():
            m, v = self.moment[k]
            g = g * fit
            part = g - m
            part *= np.float32(0.1)
            m += part
            g *= g
            g -= v
            g *= np.float32(0.001)
            v += g
            np.multiply(v, second, out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= first
            p[k] -= g


def learn_all(model: Model, adam: Adam, training: DataFrame, *, key: str = "doc_id", text: str = "text") -> int:
    """Learn once from every row of ``training``, in ROUNDS rounds: rows are dealt to rounds by a hash of the key; a task starts
    with the shared weights, learns from its own rows and sends the change of its weights; changes are summed by groups of tasks,
    then on the driver, as means weighted by tokens.  Gives the number of tokens learnt from."""
    spark, names, seen = training.sparkSession, sorted(model.p), 0
    rows = training.select(F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(ROUNDS)).alias("round"), F.col(text).alias("text"))
    for k in range(ROUNDS):
        adam.rate = RATE / (k + 1)
        shared = spark.sparkContext.broadcast((model, adam))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, adam = copy.deepcopy(shared.value)
            n = 0
            for batch in pieces(batches):
                token, kind, first = _read(batch.column(0))
                model.learn(model.encode(token, kind), first, adam, PASS_LANES)
                n += len(token)
            if n:
                change = np.concatenate([(model.p[x] - shared.value[0].p[x]).ravel() for x in names]).astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n], pa.int64()), pa.array([change.tobytes()], pa.binary())], names=["part", "n", "change"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n, total = None, 0, None
            for batch in batches:
                for i, m, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    part, n = i if part is None else part, n + m
                    change = np.frombuffer(change)
                    total = change.copy() if total is None else total + change
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "change"])

        kinds = "part long, n long, change binary"
        changes = rows.filter(F.col("round") == k).select("text").mapInArrow(run, kinds)
        # by SUMS keys, so that no more than SUMS rows come whatever the number of partitions
        dealt = changes.withColumn("key", F.pmod("part", F.lit(SUMS))).repartition(SUMS, "key").sortWithinPartitions("key", "part").drop("key")
        sums = dealt.mapInArrow(add, kinds).collect()
        n = sum(r["n"] for r in sums)
        if n:
            change = sum(np.frombuffer(r["change"]) for r in sorted(sums, key=lambda r: r["part"])) / n
            at = 0
            for x in names:
                own = model.p[x]
                own += change[at : at + own.size].reshape(own.shape).astype(np.float32)
                at += own.size
        seen += n
        shared.unpersist()
    return seen


def _long_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size, long texts in batches of their own: rows of a batch are scored side by side, as many steps as the longest
    has tokens, so a long text among short ones would run alone for most of its length."""
    held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
    size = {False: 0, True: 0}

    def together(long: bool) -> pa.RecordBatch:
        out = pa.Table.from_batches(held[long]).combine_chunks().to_batches()[0]
        held[long], size[long] = [], 0
        return out

    for batch in pieces(batches, "_text", 2 << 20):
        bytes_ = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("_text"))), 0))
        for long in (False, True):
            own = (bytes_ > LONG_BYTES) == long
            if own.any():
                held[long].append(batch.filter(pa.array(own)))
                size[long] += int(bytes_[own].sum())
            if size[long] > SCORED_BYTES:
                yield together(long)
    for long in (False, True):
        if held[long]:
            yield together(long)


def score_documents(docs: DataFrame, training: DataFrame, *, key: str = "doc_id", text: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """(key, *passed, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, learning from ``training``."""
    spark = docs.sparkSession
    counts = save(count_tokens(training, text=text), "token-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = totals["n"], totals["v"]
    common = common_tokens(counts).toPandas().sort_values(["n", "token"], ascending=[False, True])  # KNOWN rows at most
    known, known_n = common["token"].to_numpy(np.int64), common["n"].to_numpy(np.int64)
    # the end is a head token even where there is nothing to learn from
    head, head_n = known[:HEAD], known_n[:HEAD]
    if END not in head:
        end_n = int(known_n[known == END].sum())
        head, head_n = np.append(head[: HEAD - 1], END), np.append(head_n[: HEAD - 1], end_n)
    tail = counts.join(F.broadcast(spark.createDataFrame([(int(x),) for x in head], "token long")), "token", "left_anti")  # HEAD rows at most
    classes = {r["kind"]: r for r in tail.groupBy("kind").agg(F.sum(F.col("n") + 1).alias("total"), F.sum("n").alias("n")).collect()}
    model = Model(head, head_n, np.array([1.0 + (classes[k]["total"] if k in classes else 0) for k in range(TAIL_CLASSES)]), np.array([float(classes[k]["n"]) if k in classes else 0.0 for k in range(TAIL_CLASSES)]))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = [r[0] for r in training.filter(draw < SAMPLE_TOKENS / max(n_all, 1)).orderBy(F.xxhash64(F.col(key), F.lit(5)), F.col(text)).select(text).collect()]
    token, kind, first = _read(pa.array(sample, pa.string()))
    model.train(model.encode(token, kind), first)
    learn_all(model, Adam(model.p), training, key=key, text=text)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((model, known[order], np.log10(known_n[order] + 1.0)))
    columns = [F.col(c) for c in (key, *passed)]
    keep = docs.select(*columns).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, logs = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in _long_together(batches):
            token, kind, first = _read(batch.column(batch.schema.get_field_index("_text")))
            n = np.diff(first)
            of = np.repeat(np.arange(len(n)), n)
            x = model.encode(token, kind)
            heads = len(model.sorted)
            is_head = x < heads
            neural = model.score(x, first)
            at = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
            there = known[at] == token if len(known) else np.zeros(len(token), bool)
            log_count = np.where(there, logs[at], 0) if len(known) else np.zeros(len(token))
            total = lambda w: np.bincount(of, w, len(n))
            # tail tokens: their share (c + 1) / total of the class; c of those not broadcast is joined later
            tail = ~is_head
            neural += total(np.where(tail, log_count, 0)) - total(np.where(tail, model.totals[np.where(tail, x - heads, 0)], 0))
            rest = np.flatnonzero(~there)
            ends = np.searchsorted(rest, first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k) for k in range(len(keep))), pa.array(row + np.arange(len(n))), pa.array(n, pa.int64()), pa.array(total(there.astype(float)).astype(np.int64)), pa.array(total(log_count)), pa.array(neural),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(token[rest])),
            ], names=[*keep.names, "_row", "n_tokens", "_known", "_logs", "_neural", "_rest"])
            row += len(n)

    kinds = "_row long, n_tokens long, _known long, _logs double, _neural double, _rest array<long>"
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.fields)
    scored = save(docs.select(*columns, F.col(text).alias("_text")).mapInArrow(score, f"{listed}, {kinds}"), "model-scores")
    rare = scored.select("_row", F.explode("_rest").alias("token")).join(counts, "token").groupBy("_row").agg(F.count("*").alias("_more"), F.sum(F.log10(F.col("n") + 1.0)).alias("_more_logs"))
    out = scored.drop("_rest").join(rare, "_row", "left").fillna(0, ["_more", "_more_logs"])
    base = F.col("_logs") + F.col("_more_logs") - F.col("n_tokens") * float(np.log10(n_all + v_all + 1))
    return out.select(*keep.names, "n_tokens", (F.col("_known") + F.col("_more")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("_neural") + F.col("_more_logs")).alias("score"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "text")
    return score_documents(docs, docs.filter("not held_out"), passed=("held_out",))


QUERIES = {"op3_language_model": op3_language_model}
SQL: dict[str, str] = {}
