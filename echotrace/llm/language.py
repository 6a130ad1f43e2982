"""Language identification with interpolated Kneser-Ney character models.

One model of order 4 per language, learnt from a sample of labelled texts that is bounded in characters
(``sample_chars`` a language in expectation; whole texts, chosen by a hash of the key).  N-grams live in sorted arrays of 64-bit hashes; a text is
given the language of the lowest cross-entropy per character, and is *rejected* when even that is further from what
calibration texts of the language show than their ``keep`` quantile allows.

Texts are lower-cased and every run of non-letters counts as one space.  Null or letterless texts: language ``und``,
score 0, rejected.  Ties go to the language first in code-point order.  Without labelled texts, all are ``und`` and only letterless ones are rejected.
A language with few calibration texts takes its spread and limit from those of all languages, widened.  Extra columns pass through
untouched, but lang_pred, score and rejected, which are replaced; repeated rows are judged alike.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.llm.common import HASHED_BYTES, U64, held_out, mix, pieces, read_table

ORDER = 4
SAMPLE_CHARS = 4_000_000
KEEP = 0.999
FEW = 20
CALIBRATION_CHARS = 1 << 18
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces (0) of all texts, and where each text begins; every text is led by ORDER - 1 spaces."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    letter = _is_letter()[codes]
    before = np.zeros(len(codes), bool)
    before[1:] = letter[:-1]
    heads = first[:-1][first[:-1] < len(codes)]
    before[heads] = False
    keep = letter | before
    kept = np.concatenate([[0], np.cumsum(keep)])[first]
    n, pad = np.diff(kept), ORDER - 1
    out = np.zeros(int(kept[-1]) + pad * len(texts), np.int64)
    at = kept + pad * np.arange(len(texts) + 1)
    out[np.arange(kept[-1]) + np.repeat(at[:-1] + pad - kept[:-1], n)] = np.where(letter, codes, 0)[keep]
    return out, at


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of n-grams given as columns of symbols."""
    h = np.full(len(columns[0]), U64(len(columns)))
    for c in columns:
        h = h * U64(0x100000001B3F7C15) + c.astype(U64) + U64(1)
    return mix(h)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("l")["text"]:
            s, at = symbols(texts.tolist())
            places = _places(at)
            columns = [s[places + j] for j in range(ORDER)]
            _, at, n = np.unique(gram_hash(columns), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"l": pa.array(np.full(len(at), lang), pa.int32()), **{f"c{j}": pa.array(c[at], pa.int32()) for j, c in enumerate(columns)}, "n": pa.array(n, pa.int32())})


def _places(at: np.ndarray) -> np.ndarray:
    """Where the n-grams begin: one for each symbol after a text's leading spaces."""
    n = np.diff(at) - (ORDER - 1)
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(at[:-1] - (ends - n), n)


class Model:
    """For each order, sorted hashes of n-grams with log2 probabilities in every language, and of contexts with log2 weights."""

    def __init__(self, counts: pd.DataFrame, langs: list[str] | None = None):
        """``counts`` has c0 to c3, n, and the language: its name as lang, or with ``langs`` its place among them as l."""
        self.langs = langs if langs is not None else sorted(counts["lang"].unique()) if len(counts) else []
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.limits: dict[str, tuple[float, float, float]] = {}
        self.sharpness = 1.0
        if not self.langs:
            return
        alphabet = len(np.unique(counts[f"c{ORDER - 1}"])) + 1
        self.unseen = -np.log2(alphabet)
        names = [f"c{j}" for j in range(ORDER)]
        if langs is None:
            counts = counts.assign(l=counts["lang"].map({x: k for k, x in enumerate(self.langs)}))
        # types of each order with counts; below the top, counts are of distinct predecessors
        tables = [counts[["l", *names, "n"]]]
        for k in range(ORDER - 1, 0, -1):
            tables.append(tables[-1].groupby(["l", *names[ORDER - k :]], as_index=False).size().rename(columns={"size": "n"}))
        lower = None
        for k, table in enumerate(reversed(tables), 1):
            lower = self._add(table, names[ORDER - k :], lower)

    def _add(self, t: pd.DataFrame, names: list[str], lower) -> None:
        k, n_langs = len(names), len(self.langs)
        once, twice = (t["n"] == 1).groupby(t["l"]).sum(), (t["n"] == 2).groupby(t["l"]).sum()
        d = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9).reindex(range(n_langs), fill_value=0.5).to_numpy()
        context = t.groupby(["l", *names[:-1]])["n"].agg(["sum", "size"]).reset_index()
        weight = np.log2(d[context["l"]] * context["size"] / context["sum"])
        keys = gram_hash([context[c].to_numpy() for c in names[:-1]]) if k > 1 else np.full(len(context), U64(0))
        u, inverse = np.unique(keys, return_inverse=True)
        table = np.zeros((len(u), n_langs))  # an unseen context leaves everything to the lower order: log2 weight 0
        table[inverse, context["l"]] = weight
        self.contexts.append((u, table.astype(np.float32)))
        # every n-gram seen in any language gets its probability in all languages
        types = t[names].drop_duplicates()
        columns = [types[c].to_numpy() for c in names]
        keys = gram_hash(columns)
        order = np.argsort(keys)
        keys, columns = keys[order], [c[order] for c in columns]
        p = 2.0 ** self._score(columns, k - 1) * 2.0 ** self._weight(columns[:-1], k)
        total = np.ones((len(self.contexts[-1][0]), n_langs))
        total[inverse, context["l"]] = context["sum"]
        own = gram_hash([t[c].to_numpy() for c in names])
        at = np.searchsorted(keys, own)
        c_at = np.searchsorted(u, gram_hash([t[c].to_numpy() for c in names[:-1]]) if k > 1 else np.zeros(len(t), U64))
        lang = t["l"].to_numpy()
        p[at, lang] += np.maximum(t["n"].to_numpy() - d[lang], 0) / total[c_at, lang]
        self.grams.append((keys, np.log2(p).astype(np.float32)))

    def _weight(self, context: list[np.ndarray], k: int) -> np.ndarray:
        keys, table = self.contexts[k - 1]
        if k == 1:
            return np.broadcast_to(table[0], (1, len(self.langs)))
        h = gram_hash(context)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where((keys[at] == h)[:, None], table[at], 0)

    def _score(self, columns: list[np.ndarray], k: int) -> np.ndarray:
        """log2 probability, in each language, of the last symbol after the k - 1 before it."""
        n = len(columns[-1])
        if k == 0:
            return np.full((n, len(self.langs)), self.unseen, np.float32)
        keys, table = self.grams[k - 1]
        h = gram_hash(columns[-k:])
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = table[at]
        if len(missing := np.flatnonzero(keys[at] != h)):
            fewer = [c[missing] for c in columns[-k:]]
            out[missing] = self._weight(fewer[:-1], k) + self._score(fewer, k - 1)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a symbol in each language, and the number of symbols, of each text."""
        s, at = symbols(texts)
        places = _places(at)
        n = np.diff(at) - (ORDER - 1)
        out = np.zeros((len(texts), len(self.langs)))
        if len(places):
            scores = self._score([s[places + j] for j in range(ORDER)], ORDER)
            row = np.repeat(np.arange(len(n)), n)
            for k in range(len(self.langs)):
                out[:, k] = -np.bincount(row, scores[:, k], len(n)) / np.maximum(n, 1)
        return out, n

    def judge(self, texts: list[str | None]) -> pd.DataFrame:
        """Language, score and whether it is rejected."""
        if not self.langs:
            return pd.DataFrame({"lang_pred": "und", "score": np.zeros(len(texts)), "rejected": np.diff(symbols(texts)[1]) == ORDER - 1})
        h, n = self.entropies(texts)
        best = h.argmin(1)
        low = h.min(1)
        score = 1 / np.exp2(-np.minimum(self.sharpness * (h - low[:, None]) * np.sqrt(np.maximum(n, 1))[:, None], 500)).sum(1)
        mean, spread, z = (np.array([self.limits.get(x, (0, 1e9, 1))[j] for x in self.langs])[best] for j in range(3))
        far = low > mean + z * np.sqrt(spread**2 + 4.0 / np.maximum(n, 1))
        none = n == 0
        return pd.DataFrame({"lang_pred": np.where(none, "und", np.array(self.langs, object)[best]), "score": np.where(none, 0, score), "rejected": none | far})

    def calibrate(self, texts: list[str], langs: list[str], keep: float) -> None:
        """Set how sharp scores are, and how far from a language's own texts is too far."""
        if not self.langs or not texts:
            return
        # some texts at a time bound the arrays
        starts = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum([len(t or "") for t in texts]) // CALIBRATION_CHARS])))
        h, n = map(np.concatenate, zip(*(self.entropies(texts[a:b]) for a, b in zip(starts, [*starts[1:], len(texts)]))))
        number = {x: k for k, x in enumerate(self.langs)}
        true = np.array([number.get(x, -1) for x in langs])
        h, n, true = h[(n > 0) & (true >= 0)], n[(n > 0) & (true >= 0)], true[(n > 0) & (true >= 0)]
        if not len(n):
            return
        gap = (h - h.min(1)[:, None]) * np.sqrt(n)[:, None]

        def loss(a: float) -> float:
            return float(np.mean(np.log2(np.exp2(-np.minimum(a * gap, 500)).sum(1)) + np.minimum(a * gap[np.arange(len(n)), true], 500)))

        self.sharpness = min(np.geomspace(0.05, 20, 30), key=loss)
        spread_of = lambda own: float(max(0.02, 1.4826 * np.median(np.abs(own - np.median(own)))))
        every = {k: h[true == k, k] for k in number.values()}
        centred = np.concatenate([own - np.median(own) for own in every.values() if len(own)])
        pooled = max([spread_of(own) for own in every.values() if len(own) >= FEW] or [spread_of(centred)])
        typical = float(np.median(np.concatenate(list(every.values()))))
        for x, k in number.items():
            own = every[k]
            middle = float(np.median(own)) if len(own) else typical
            spread = spread_of(own) if len(own) >= FEW else pooled * (1 + FEW / (len(own) + 1))
            z = (own - middle) / np.sqrt(spread**2 + 4.0 / n[true == k])
            self.limits[x] = middle, spread, float(max([4.0, *([1.25 * np.quantile(z, keep)] if len(own) else [])]))


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_chars: int = SAMPLE_CHARS, keep: float = KEEP) -> Model:
    """Learn a model from texts with a language.  Sizes are summed over all rows; then a hash of key and text picks about ``sample_chars``
    characters a language: four fifths to learn from, the others to calibrate on.  Of every language, the text with the least hash is learnt from, however few it has."""
    known = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.withColumn("draw", F.pmod(F.xxhash64("k", "text", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    spoken = F.length(F.trim("text")) > 0
    sizes = known.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.coalesce(F.min(F.when(spoken, F.col("draw"))), F.min("draw")).alias("least")).orderBy("lang").limit(1001).collect()
    if len(sizes) > 1000:
        raise ValueError("over 1000 languages")
    spark = docs.sparkSession
    langs = sorted(r["lang"] for r in sizes)
    shares = spark.createDataFrame([(r["lang"], min(1.0, sample_chars / max(r["chars"], 1)), r["least"], langs.index(r["lang"])) for r in sizes], "lang string, share double, least double, l int")
    known = known.join(F.broadcast(shares), "lang")  # at most 1000 rows
    learnt = (F.col("draw") < F.col("share") * 0.8) | (F.col("draw") == F.col("least"))
    counts = known.filter(learnt).select("l", "text")
    grams = [f"c{j}" for j in range(ORDER)]
    counts = counts.mapInArrow(_count, "l int, c0 int, c1 int, c2 int, c3 int, n int").groupBy("l", *grams).agg(F.sum("n").cast("int").alias("n"))
    counts = counts.toPandas()
    seen = sorted(counts["l"].unique().tolist())
    model = Model(counts.assign(l=np.searchsorted(seen, counts["l"]).astype(np.int32)), [langs[k] for k in seen])
    del counts
    calibration = known.filter(~learnt & (F.col("draw") < F.col("share"))).select("lang", "text").toPandas()
    model.calibrate(calibration["text"].tolist(), calibration["lang"].tolist(), keep)
    return model


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string, score double and rejected boolean."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("rejected", pa.bool_())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, HASHED_BYTES):
            out = shared.value.judge(batch.column(batch.schema.get_field_index(text)).to_pylist())
            columns = [pa.array(out[f.name].tolist(), f.type) for f in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema([*batch.schema, *added]))

    docs = docs.drop(*[f.name for f in added])
    kinds = T.StringType(), T.DoubleType(), T.BooleanType()
    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *(T.StructField(f.name, k) for f, k in zip(added, kinds, strict=True))]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out: Column = held_out("doc_id", 5, 0)
    model = fit(docs.filter(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
