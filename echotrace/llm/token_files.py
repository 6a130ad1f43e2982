"""Token ids in binary shards of independent zstandard frames.

A shard is in the public *seekable* zstandard layout: frames of whole documents, a frame with the index of the shard's
documents, then a seek table in a skippable frame (each frame's compressed size, size and checksum: the low 32 bits of XXH64).
A reader takes the table from the file's end, the index, and then only the frames of the documents that it wants; it checks
every frame that it opens.  Ids are little-endian, 2 bytes where the vocabulary allows it, else 4.

Documents are range-partitioned by id; each task sorts its range, encodes whole texts and writes shards under names of
their own, so a repeated task never harms a finished one: only shards that the committed manifest lists are read.

Null texts count as empty and have the end id alone; rows with the same id all stay, ordered by text; null ids come first;
very long texts make long frames; an empty table makes an empty manifest.  Other columns aren't read.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.llm.common import U64, new_path, pieces, read_table, save, span_hashes, word_spans

FRAME_IDS, SHARD_IDS = 1 << 18, 1 << 22
CACHED_WORDS = 1_000_000
END_ID = 2
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = struct.Struct("<4sHHQ")


class Pool:
    """A growing array."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(self.n + len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


def stretches(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at[0], at[0] + 1, ... (n[0] of them), at[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(n) else 0)


#: Fixed values, from the tokenizer's file: how it cuts a text; other tokenizers get whole words
CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[:128] = _SIGN
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER  # 0xC3: the letters from U+00C0 to U+00FF, but for two signs
_KIND[48:58] = _DIGIT
_KIND[39] = _ODD  # an apostrophe may join what follows
#: the characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) if b in _PRINTABLE else chr(0x100 + b - sum(x < b for x in _PRINTABLE)) for b in range(256)}


def cut_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut words into runs of letters, single digits and runs of signs, as ``CUT`` does: the bytes with letters lower-cased, where pieces start
    and end, and whether each is plain.  Words with an apostrophe, a special token's ``<|`` or other than ASCII and Latin letters stay whole, as they are."""
    kind, low = _KIND[data], data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    at = np.flatnonzero(second)
    sign = (data[at] == 0x97) | (data[at] == 0xB7)
    kind[at] = np.where(sign, _ODD, _LETTER)
    high = at[(data[at] < 0x9F) & ~sign]
    low[high] += 32
    odd = kind == _ODD
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    whole = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
    new = np.zeros(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    inside = stretches(starts[whole], ends[whole] - starts[whole])
    new[inside], low[inside] = False, data[inside]
    solid = np.zeros(len(data), bool)
    solid[stretches(starts, ends - starts)] = True
    new &= solid
    new[starts] = True
    first = np.flatnonzero(new)
    last = np.empty(len(first), np.int64)
    last[:-1] = first[1:]
    closes = np.searchsorted(first, starts)  # each word's first piece; the piece before it ends with its word
    last[closes[1:] - 1] = ends[:-1]
    if len(ends):
        last[-1] = ends[-1]
    plain = np.ones(len(first), bool)
    plain[closes[whole]] = False
    return low, first, last, plain


class WordEncoder:
    """Ids of whole texts by a tokenizer that never looks across white space: it sees a piece of a word once, later ones take its ids by numpy.

    Known pieces are found by a 64-bit hash in a sorted array and then compared byte by byte; a text with a piece of the same hash as
    another is encoded as a whole.  Plain pieces go right to the tokenizer's model, other words through all of it.  Beyond ``cached``
    pieces, those go that were met longest ago."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.turn = Tokenizer.from_file(path), cached, 0
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        made = json.loads(self.tokenizer.to_str())
        steps = lambda x, many: [s["type"] for s in (made[x] or {}).get(many, [])]
        self.cuts = (
            steps("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and steps("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"] and made["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": CUT}
            and all(t["content"].startswith("<|") for t in made["added_tokens"])
        )
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, U64), np.zeros(0, np.int32)  # sorted by hash
        self.at, self.id_at, self.length, self.id_n, self.met = (Pool(kind) for kind in (np.int64, np.int64, np.int32, np.int32, np.int32))  # by slot
        self.bytes, self.ids = Pool(np.uint8), Pool(np.uint32)

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(words), 4096) for e in self.tokenizer.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)]

    def _tokenize(self, words: list[bytes], plain: np.ndarray) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        odd = iter(self._whole([w.decode() for w, p in zip(words, plain, strict=True) if not p]))
        return [[t.id for t in tokenize(w.decode() if w.isascii() and w.decode().isprintable() else w.decode("latin1").translate(_SHOWN))] if p else next(odd) for w, p in zip(words, plain.tolist(), strict=True)]

    def _add(self, hashes: np.ndarray, text: np.ndarray, length: np.ndarray, ids: np.ndarray, id_n: np.ndarray, met: np.ndarray) -> None:
        slots = self.at.n + np.arange(len(hashes))
        self.at.add(self.bytes.n + np.cumsum(length) - length)
        self.id_at.add(self.ids.n + np.cumsum(id_n) - id_n)
        for pool, values in ((self.bytes, text), (self.length, length), (self.ids, ids), (self.id_n, id_n), (self.met, met)):
            pool.add(values)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, place, hashes), np.insert(self.slots, place, slots)

    def _keep_newest(self) -> None:
        met = self.met.data[self.slots]
        keep = met > np.partition(met, len(met) // 2)[len(met) // 2]
        hashes, s = self.hashes[keep], self.slots[keep]
        length, id_n, met = (x.data[s].astype(np.int64) for x in (self.length, self.id_n, self.met))
        text, ids = self.bytes.data[stretches(self.at.data[s], length)], self.ids.data[stretches(self.id_at.data[s], id_n)]
        self._forget()
        self._add(hashes, text, length, ids, id_n, met)

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The slot of each piece, new ones after they were learnt."""
        if len(self.hashes) > self.cached or self.bytes.n > 64 * self.cached:
            self._keep_newest()
        self.turn += 1
        u, at, inverse = np.unique(span_hashes(data, starts, ends, exact=True), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, u)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == u[known]
        if not known.all():
            new = at[~known]
            ids = self._tokenize([data[s:e].tobytes() for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], plain[new])
            length, id_n = ends[new] - starts[new], np.array(list(map(len, ids)), np.int64)
            self._add(u[~known], data[stretches(starts[new], length)], length, np.array([x for own in ids for x in own], np.uint32), id_n, np.full(len(new), self.turn))
            place = np.searchsorted(self.hashes, u)
        slots = self.slots[place]
        self.met.data[slots] = self.turn
        return slots[inverse]

    def cut(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, where pieces start and end, whether each is plain, and where each text begins."""
        data, starts, ends, first = word_spans(text)
        rows_at = np.append(starts, len(data))[first]
        plain = np.zeros(len(starts), bool)
        if self.cuts:
            data, starts, ends, plain = cut_words(data, starts, ends)
        return data, starts, ends, plain, rows_at

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), and where each text's begin."""
        data, starts, ends, plain, rows_at = self.cut(text)
        slots = self._slots(data, starts, ends, plain)
        length, id_n = ends - starts, self.id_n.data[slots]
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(id_n)])[np.searchsorted(starts, rows_at)]
        out = self.ids.data[stretches(self.id_at.data[slots], id_n)]
        wrong = length != self.length.data[slots]
        like = np.flatnonzero(~wrong)
        differ = np.flatnonzero(self.bytes.data[stretches(self.at.data[slots[like]], length[like])] != data[stretches(starts[like], length[like])])
        wrong[like[np.searchsorted(np.cumsum(length[like]), differ, "right")]] = True
        if not wrong.any():
            return out, at
        parts = [out[a:b] for a, b in zip(at, at[1:])]
        for k in np.unique(np.searchsorted(np.searchsorted(starts, rows_at), np.flatnonzero(wrong), "right") - 1).tolist():
            parts[k] = np.array(self._whole([text[k].as_py()])[0], np.uint32)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a Python worker: its tasks share the remembered words.  Spark's tasks fill the cores: no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


class ShardWriter:
    """Frames of a shard, in memory until it is written; a shard has about SHARD_IDS ids."""

    def __init__(self, width: int):
        self.kind, self.out, self.table = np.dtype(f"<u{width}"), io.BytesIO(), []
        self.held, self.held_ids, self.ids = [], 0, 0
        self.doc_ids, self.nulls, self.counts, self.frames = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held_ids and self.held_ids + len(ids) > FRAME_IDS:
            self.flush()
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.frames.append(len(self.table))
        self.held.append(ids.astype(self.kind))
        self.held_ids += len(ids)
        self.ids += len(ids)

    def frame(self, data: bytes) -> None:
        packed = zstandard.ZstdCompressor(level=3).compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.held:
            self.frame(np.concatenate(self.held).tobytes())
            self.held, self.held_ids = [], 0

    def close(self) -> bytes:
        self.flush()
        n = len(self.doc_ids)
        self.frame(_INDEX.pack(b"TOKS", 1, self.kind.itemsize, n) + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.frames, "<u4").tobytes())
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        return self.out.getvalue()


class ShardReader:
    """Random access to a shard: ``documents`` gives (doc_id, ids), of all or of the places asked for, opening only their frames."""

    def __init__(self, file):
        self.file, size = file, file.seek(0, 2)
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != _SEEKABLE or flags != 0x80:
            raise ValueError("not a shard with a seek table")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        data = self.frame(n - 1)
        magic, _, width, docs = _INDEX.unpack_from(data)
        if magic != b"TOKS":
            raise ValueError("not an index")
        self.kind, at = np.dtype(f"<u{width}"), _INDEX.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.nulls = np.frombuffer(data, "u1", docs, at + 8 * docs)
        self.counts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.frames = np.frombuffer(data, "<u4", docs, at + 17 * docs)

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.at[k]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, places: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        ends = np.cumsum(self.counts)
        opened, ids, base = -1, np.zeros(0, self.kind), 0
        for k in range(len(self.counts)) if places is None else places:
            if self.frames[k] != opened:
                opened = int(self.frames[k])
                ids = np.frombuffer(self.frame(opened), self.kind)
                first = int(np.searchsorted(self.frames, opened))
                base = int(ends[first] - self.counts[first])
            yield (None if self.nulls[k] else int(self.doc_ids[k])), ids[ends[k] - self.counts[k] - base : ends[k] - base]


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer: str, *, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID, in_file_order: bool = False) -> DataFrame:
    """Write shards under ``folder`` (default: in the shared folder) and return the committed manifest:
    part, shard, path, docs, tokens, start (ids in all shards before).

    Documents are written by ascending id; with ``in_file_order``, in the order of the files that ``docs`` is read from (a table without files: by id)."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    order = ["doc_id", "text"]
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    if in_file_order and docs.inputFiles():
        order = ["_file", "_at"]
        rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (files, root) = word_encoder(tokenizer), _files(folder)
        width = 2 if max(encode.vocabulary, end_id + 1) <= 1 << 16 else 4
        part, shard, writer = TaskContext.get().partitionId(), 0, ShardWriter(width)

        def close() -> pa.RecordBatch:
            files.create_dir(root, recursive=True)
            name = f"shard-{part:06d}-{shard:04d}-{uuid.uuid4().hex[:12]}.zst"
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(writer.close())
            row = part, shard, f"{folder}/{name}", len(writer.counts), writer.ids
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in pieces(batches, limit=1 << 20):
            ids, at = encode(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                writer.add(doc_id, np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)))
                if writer.ids >= SHARD_IDS:
                    yield close()
                    shard, writer = shard + 1, ShardWriter(width)
        if writer.counts:
            yield close()

    manifest = save(rows.mapInArrow(write, "part long, shard long, path string, docs long, tokens long"), "token-manifest")
    # one row a shard: a running sum that one task can hold however many documents there are
    before = F.sum("tokens").over(Window.orderBy("part", "shard")) - F.col("tokens")
    return manifest.withColumn("start", before)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of ids as unsigned 32-bit) of every document in the shards."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, name = _files(path)
                with files.open_input_file(name) as file:
                    reader = ShardReader(file)
                    docs, sums = [], []
                    for doc_id, ids in reader.documents():
                        docs.append(doc_id)
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = start + np.cumsum(reader.counts) - reader.counts
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(reader.counts, pa.int64()), pa.array(sums, pa.int64())], schema=schema)

    shards = manifest.select("path", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_index(manifest: DataFrame) -> DataFrame:
    """(doc_id, path, place) of every document, from the shards' index frames alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = _files(path)
                with files.open_input_file(name) as file:
                    reader = ShardReader(file)
                n = len(reader.doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64(), mask=reader.nulls != 0), pa.array([path] * n), pa.array(np.arange(n), pa.int64())], names=["doc_id", "path", "place"])

    shards = manifest.select("path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.mapInArrow(read, "doc_id long, path string, place long")


def read_documents(manifest: DataFrame, wanted: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>) of the documents whose ids ``wanted`` has (each id once, all documents of it; null ids aren't found), opening
    only their frames.  Ids are joined with the index; a shard is opened once for all that is wanted of it."""
    asked = wanted.select(F.col(f"`{key}`").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    found = asked.join(shard_index(manifest), "doc_id").select("path", "place")
    dealt = found.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader, file = None, None, None
        for batch in batches:
            names, places = batch.column(0), batch.column(1).to_numpy()
            for name in names.unique().to_pylist():
                if name != path:
                    if file is not None:
                        file.close()
                    files, at = _files(name)
                    path, file = name, files.open_input_file(at)
                    reader = ShardReader(file)
                for doc_id, tokens in reader.documents(places[np.asarray(pc.equal(names, name))].tolist()):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([tokens.astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"])
        if file is not None:
            file.close()

    return dealt.mapInArrow(read, "doc_id long, ids array<int>")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json"))))


QUERIES = {"op2_token_files": op2_token_files}
SQL: dict[str, str] = {}
