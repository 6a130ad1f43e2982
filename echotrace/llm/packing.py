"""Documents packed into sequences of bounded length: repeated patterns of few lengths, fitted to the histogram of lengths.

Texts are encoded whole; a document longer than a sequence is cut into pieces of a sequence's length, of which the first may be shorter.
What is then to be packed is a histogram of at most ``longest`` lengths, whatever the corpus holds, and all planning works on it:

* patterns of two or three lengths that leave no room for another are enumerated: where all lengths occur, those that fill a sequence exactly;
* non-negative least squares fits how often each pattern is to be repeated to the histogram (an active set whose equations are solved by
  conjugate gradients; patterns enter in blocks that share no length);
* repeats are rounded within what the histogram has, and the residual histogram is packed by best fit, equal sequences together.  Of a few
  roundings, from all repeats to none of them, that with the fewest sequences stays.

A piece then only needs its rank among those of its length: tasks count what they write, the counts of the tasks before are added, and
the plan, which holds some thousand ranges of ranks, tells the sequence and the place.  So one length that all documents have is spread like any other.
Sequences are put together by one shuffle of the ids.

A null text counts as empty and is the end id alone; null and repeated ids stay, each row for itself; an empty table gives no sequences.
Other columns aren't read.  Which of the documents of one length stand together is chance.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.llm.common import Scratch, pieces, read_table
from echotrace.llm.token_files import _DIGIT, _KIND, _LETTER, _ODD, _SHOWN, WordEncoder, stretches

LONGEST, END_ID = 2048, 0
ROUNDS, STEPS, ENTERING = 80, 120, 20_000

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[[*range(9), *range(14, 32), 127]] = True
#: white space beyond ASCII, as UTF-8
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _starts_of(data: np.ndarray, pattern: bytes) -> np.ndarray:
    """Where ``pattern`` stands."""
    n = len(data) - len(pattern) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = np.flatnonzero(data[:n] == pattern[0])
    for k in range(1, len(pattern)):
        found = found[data[found + k] == pattern[k]]
    return found


class ByteEncoder(WordEncoder):
    """Ids of whole texts by a byte-level tokenizer, which splits texts into runs of letters, digits or signs, each with the one space before it, and
    runs of white space.  Pieces are cut here, and the tokenizer sees each piece once.  Words with an apostrophe or with other than ASCII and Latin letters
    are pieces as a whole; so are texts with control characters, white space beyond ASCII or what may be a special token."""

    def __init__(self, path: str, **more):
        super().__init__(path, **more)
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        self.cuts = made["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and all(t["content"].startswith("<|") for t in made["added_tokens"])

    def _tokenize(self, words: list[bytes], plain: np.ndarray) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        odd = iter(self._whole([w.decode() for w, p in zip(words, plain, strict=True) if not p]))
        return [[t.id for t in tokenize(w.decode("latin1").translate(_SHOWN))] if p else next(odd) for w, p in zip(words, plain.tolist(), strict=True)]

    def cut(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        text, n = text.cast(pa.string()), len(text)
        buffers = text.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        size = len(data)
        first = np.zeros(size + 1, bool)
        first[offsets] = True
        if not self.cuts:
            starts = np.flatnonzero(first[:size])
            return data, starts, np.append(starts[1:], size)[: len(starts)], np.zeros(len(starts), bool), offsets
        blank, kind, odd = _BLANK[data], _KIND[data], np.zeros(size, bool)
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        kind[second] = np.where((data[second] == 0x97) | (data[second] == 0xB7), _ODD, _LETTER)
        after_blank, after = np.zeros(size, bool), np.zeros(size, np.uint8)
        after_blank[1:], after[1:] = blank[:-1] & ~first[1:size], data[:-1]
        before_word = np.zeros(size, bool)
        before_word[:-1] = ~blank[1:] & ~first[1:size]
        changes = np.ones(size, bool)
        changes[1:] = kind[1:] != kind[:-1]
        new = first[:size] | np.where(blank, ~after_blank | before_word, np.where(after_blank, after != 32, changes))
        # words that aren't plain are one piece
        word_at = np.flatnonzero(~blank & (first[:size] | after_blank))
        closes = np.ones(size, bool)
        closes[:-1] = blank[1:] | first[1:size]
        word_to = np.flatnonzero(~blank & closes) + 1
        whole = np.unique(np.searchsorted(word_at, np.flatnonzero(~blank & (kind == _ODD)), "right") - 1)
        new[stretches(word_at[whole] + 1, word_to[whole] - word_at[whole] - 1)] = False
        # nor are these texts
        strange = np.concatenate([np.flatnonzero(_CONTROL[data]), _starts_of(data, b"<|"), *(_starts_of(data, w) for w in _WIDE)]) if (data >= 0x80).any() or _CONTROL[data].any() or (data == 60).any() else np.zeros(0, np.int64)
        texts = np.unique(np.searchsorted(offsets, strange, "right") - 1)
        new[stretches(offsets[texts] + 1, offsets[texts + 1] - offsets[texts] - 1)] = False
        starts = np.flatnonzero(new)
        plain = np.ones(len(starts), bool)
        plain[np.searchsorted(starts, word_at[whole], "right") - 1] = False
        plain[np.searchsorted(starts, offsets[texts], "right") - 1] = False
        return data, starts, np.append(starts[1:], size)[: len(starts)], plain, offsets


@lru_cache(maxsize=1)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder a Python worker, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteEncoder(path, cached=400_000)


def cut_documents(docs: DataFrame, tokenizer: str, scratch: Scratch, *, longest: int = LONGEST, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids (little-endian, of 2 bytes where the vocabulary allows it, else 4), _part and
    _nth: the task that wrote it, and how many of this length that task had written before."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids", "_part", "_nth"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, written = byte_encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        kind = np.dtype("<u2" if max(encode.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
        for batch in pieces(batches, limit=1 << 20):
            ids, at = encode(batch.column(1))
            n = np.diff(at) + 1
            head = (n - 1) % longest + 1  # the first piece
            count = (n - head) // longest + 1
            row = np.repeat(np.arange(len(n)), count)
            piece = stretches(np.zeros(len(n), np.int64), count)
            length = np.where(piece == 0, head[row], longest)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * longest)
            order = np.argsort(length, kind="stable")
            own = np.empty(len(length), np.int64)
            own[order] = np.arange(len(length)) - np.searchsorted(length[order], length[order])
            nth = written[length] + own
            written += np.bincount(length, minlength=longest + 1)
            ended = np.insert(ids, at[1:], end_id).astype(kind)
            begins = at[row] + row + start
            data = [ended[a : a + m].tobytes() for a, m in zip(begins.tolist(), length.tolist(), strict=True)]
            columns = batch.column(0).take(pa.array(row)), piece, start, length, data, np.full(len(row), part), nth
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return scratch.save(rows.mapInArrow(cut, "doc_id long, piece int, start long, length int, ids binary, _part long, _nth long"), "pieces")


def patterns_of(lengths: np.ndarray, longest: int) -> np.ndarray:
    """Patterns a >= b >= c of two or three of these lengths that leave room for none of them, c being the longest that fits; a pair's c is 0."""
    n = np.arange(longest + 1)
    below = np.zeros(longest + 1, np.int64)  # the longest of the lengths up to n
    below[lengths] = lengths
    below = np.maximum.accumulate(below)
    out = []
    for a in lengths:
        b = n[1 : min(a, longest - a) + 1]
        b = b[below[b] == b]
        c = below[longest - a - b]
        keep = c <= b
        out.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(counts: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which patterns to use and how often: non-negative least squares of their lengths to ``counts`` (by length; that at 0 is free)."""
    goal = counts.astype(float)
    goal[0] = 0

    def uses(active: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.bincount(patterns[active].ravel(), np.repeat(x, 3), len(goal))
        out[0] = 0
        return out

    def solve(active: np.ndarray, x: np.ndarray) -> np.ndarray:
        own = patterns[active]
        r = (goal - uses(active, x))[own].sum(1)
        p, rr = r, float(r @ r)
        for _ in range(STEPS):
            if rr <= 1e-12 * max(1.0, goal @ goal):
                break
            q = uses(active, p)[own].sum(1)
            alpha = rr / max(float(p @ q), 1e-300)
            x, r = x + alpha * p, r - alpha * q
            p, rr = r + float(r @ r) / rr * p, float(r @ r)
        return x

    active, x, left = np.zeros(0, np.int64), np.zeros(0), goal
    fill = (patterns.sum(1) / max(patterns.sum(1).max(initial=1), 1)) ** 8  # of patterns that fit alike, fuller ones enter first
    for _ in range(ROUNDS):
        gain = left[patterns].sum(1) * fill
        gain[active] = 0
        order = np.argpartition(-gain, min(ENTERING, len(gain) - 1))[:ENTERING] if len(gain) else active
        order = order[np.argsort(-gain[order], kind="stable")]
        taken, entering = np.zeros(len(goal), bool), []
        for k, lengths in zip(order.tolist(), patterns[order].tolist(), strict=True):
            own = [n for n in lengths if n]
            if gain[k] > 1e-3 and not any(taken[n] for n in own):
                taken[own] = True
                entering.append(k)
        if not entering:
            break
        active, x = np.append(active, entering), np.append(x, np.zeros(len(entering)))
        for _ in range(4):
            x = solve(active, x)
            good = x > 1e-9
            if good.all():
                break
            active, x = active[good], x[good]
        x = np.maximum(x, 0)
        before, left = left @ left, goal - uses(active, x)
        if before - left @ left < 1e-4 * before:
            break
    return active, x


def best_fit(counts: np.ndarray, longest: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times), ...]): all of the histogram, longest first, each to where it leaves the least room.  Equal sequences are filled at once."""
    open_: dict[int, list] = defaultdict(list)  # by room: (repeats, contents)
    rooms = np.zeros(longest + 1, bool)

    def put(repeats: int, held: list, room: int) -> None:
        if repeats:
            open_[room].append((repeats, held))
            rooms[room] = True

    for length in np.flatnonzero(counts[1:])[::-1] + 1:
        length, c = int(length), int(counts[length])
        while c:
            at = int(rooms[length:].argmax()) + length
            if rooms[at]:
                repeats, held = open_[at].pop()
                rooms[at] = bool(open_[at])
            else:
                at, repeats, held = longest, c, []
            each = min(at // length, c)
            filled = min(repeats, c // each)
            c -= filled * each
            if held:
                put(repeats - filled, held, at)
            put(filled, [*held, (length, each)], at - each * length)
    return [group for groups in open_.values() for group in groups]


def plan(counts: np.ndarray, longest: int = LONGEST) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times), ...]) over all sequences; ``counts`` has how many pieces of each length there are, from 0 on."""
    left = counts.astype(np.int64).copy()
    whole = [(int(left[longest]), [(longest, 1)])] if left[longest] else []
    left[[0, longest]] = 0
    patterns = patterns_of(np.flatnonzero(left), longest)
    active, x = fit(left, patterns)
    found = []
    for rounding, share in ((np.round, 1.0), (np.floor, 1.0), (np.floor, 0.5), (np.floor, 0.0)):
        rest, own = left.copy(), []
        for k in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(patterns[active[k]][patterns[active[k]] > 0], return_counts=True)
            repeats = min(int(rounding(share * x[k])), int((rest[lengths] // times).min()))
            if repeats > 0:
                rest[lengths] -= repeats * times
                own.append((repeats, list(zip(lengths.tolist(), times.tolist(), strict=True))))
        found.append([*whole, *own, *best_fit(rest, longest)])
    return min(found, key=lambda groups: sum(g[0] for g in groups))


def ranges(groups: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, sequence, times, offset): ranks first to last - 1 of this length go to sequences from ``sequence`` on, ``times`` to each, from ``offset`` on."""
    used, sequence, out = defaultdict(int), 0, []
    for repeats, held in groups:
        offset = 0
        for length, times in held:
            out.append((length, used[length], used[length] + repeats * times, sequence, times, offset))
            used[length] += repeats * times
            offset += length * times
        sequence += repeats
    return out


def pack(docs: DataFrame, tokenizer: str, *, longest: int = LONGEST, end_id: int = END_ID, scratch: Scratch | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences: sequence_id, ids, and by piece doc_ids, pieces, starts and lengths, in order."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    cut = cut_documents(docs, tokenizer, scratch, longest=longest, end_id=end_id, key=key, text=text)
    sizes = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = scratch.save(sizes.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"), "_n"), "counts")
    counts = np.zeros(longest + 1, np.int64)
    for row in before.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # one row a length at most
        counts[row["length"]] = row["n"]
    planned = spark.createDataFrame(ranges(plan(counts, longest)), "length int, first long, last long, sequence long, times long, base long")
    rank = F.col("_before") + F.col("_nth")
    ranked = cut.join(before.drop("_n"), ["length", "_part"]).withColumn("rank", rank)
    # bounded: ranges of ranks, by lengths, not by documents
    placed = ranked.join(F.broadcast(planned), (ranked["length"] == planned["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).drop(planned["length"])
    nth = F.col("rank") - F.col("first")
    placed = placed.select((F.col("sequence") + F.floor(nth / F.col("times"))).alias("sequence_id"), (F.col("base") + nth % F.col("times") * F.col("length")).alias("offset"), "doc_id", "piece", "start", "length", "ids")
    dealt = placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        sequence, held = None, ([], [], [], [], [])

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

        def row() -> tuple:
            return sequence, b"".join(held[4]), *held[:4]

        for batch in batches:
            for own, _, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != sequence:
                    if held[0]:
                        out.append(row())
                    sequence, held = own, ([], [], [], [], [])
                    if len(out) == 256:
                        yield rows()
                        out = []
                for column, value in zip(held, values, strict=True):
                    column.append(value)
        if held[0]:
            out.append(row())
        if out:
            yield rows()

    packed = scratch.save(dealt.mapInArrow(together, "sequence_id long, ids binary, doc_ids array<bigint>, pieces array<int>, starts array<bigint>, lengths array<int>"), "sequences")
    scratch.drop("pieces", "counts")
    return packed


def unpack(sequences: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of ids as unsigned 32-bit), sequence_id and offset of every piece, read from the sequences."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sequence, data, docs, own, starts, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, offset = np.frombuffer(data, f"<u{len(data) // sum(lengths)}").astype("<u4"), 0
                for doc_id, piece, start, length in zip(docs, own, starts, lengths, strict=True):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[offset : offset + length].tobytes()), sequence, offset))
                    offset += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names=names)

    return sequences.select("sequence_id", "ids", "doc_ids", "pieces", "starts", "lengths").mapInArrow(read, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return unpack(pack(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json"))))


QUERIES = {"op13_best_fit_packing": op13_best_fit_packing}
SQL: dict[str, str] = {}
