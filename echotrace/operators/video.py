"""Fingerprints of videos, their diagnostics, and matches by file, by frames and by metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions.names import metadata_hash
from echotrace.functions.similarity import FRAMES, SLACK_MS, SLACK_SHARE, STRONG, STRONG_FRAMES
from echotrace.operators.sliding import MET, SECOND, coded, meet, moment, packed, sender_counts, with_history
from echotrace.operators.sweep import BLOCK, TILE, before, dealt, swept, times
from echotrace.shared import saved

# fixed values: the tiers of a match in their order, kinds of analysis, and sources that belong to the message itself
TIERS = ("video_sha256", "video_frame_hash", "video_metadata")
BOUND_SOURCES = ("component_path", "get_file_local", "get_file_http")
VERSION = 1
FRAME_BITS = 256
MEGABYTE = 1 << 20
#: pairs of a video and a sender that a task holds before it sends them
MOST = 1 << 22


def size_diagnostics(declared: Column, actual: Column) -> Column:
    """struct (size_mismatch, size_delta_bytes, size_ratio): both sizes known and different, what is more or less, and the ratio to six digits."""
    known = (F.coalesce(declared, F.lit(0)) > 0) & (F.coalesce(actual, F.lit(0)) > 0)
    return F.struct(
        F.coalesce(known & (declared != actual), F.lit(False)).alias("size_mismatch"), F.when(known, actual - declared).alias("size_delta_bytes"), F.when(known, F.round(actual / declared, 6)).alias("size_ratio")
    )


def is_bound(source_method: Column) -> Column:
    """Whether a source belongs to the message, so that a wrong declared size doesn't matter."""
    return F.coalesce(source_method.isin(*BOUND_SOURCES), F.lit(False))


def fingerprint(video: Column, *, limit_mb: int = 100) -> Column:
    """The fingerprint struct of a video from what is known of it.

    ``video`` has name, declared_size, source, source_method, source_conflict, and what was found of the file: actual_size (null: not read),
    readable boolean, sha256, frame_hashes, duration_ms, width, height.  Over the limit: metadata alone.  Unreadable, or of another
    size than declared and not the message's own: unavailable.  Else by its file, and by five frames where they could be taken."""
    limit = limit_mb * MEGABYTE
    declared, actual = video["declared_size"], video["actual_size"]
    sizes = size_diagnostics(declared, actual)
    unread = ~F.coalesce(video["readable"], F.lit(False)) | (F.coalesce(video["source"], F.lit("")) == "")
    wrong = sizes["size_mismatch"] & ~is_bound(video["source_method"])
    framed = F.coalesce((F.size(video["frame_hashes"]) == FRAMES) & (video["duration_ms"] > 0), F.lit(False)) & video["sha256"].isNotNull()
    kind = F.when(F.coalesce(declared > limit, F.lit(False)), "metadata").when(unread, "unavailable").when(wrong, "unavailable").when(F.coalesce(actual > limit, F.lit(False)), "metadata")
    kind = kind.when(framed, "perceptual").otherwise("sha256")
    early = F.coalesce(declared > limit, F.lit(False)) | unread
    size = F.when(early, declared).otherwise(F.coalesce(actual, declared))
    by_file = kind.isin("sha256", "perceptual")
    none = lambda field: F.when(by_file & video["sha256"].isNotNull(), video[field])
    return F.struct(
        F.lit(VERSION).alias("version"), video["name"].alias("name"), size.cast("bigint").alias("size"), declared.cast("bigint").alias("declared_size"), none("sha256").alias("sha256"),
        F.when(kind == "perceptual", video["frame_hashes"]).otherwise(F.array().cast("array<string>")).alias("frame_hashes"), none("duration_ms").alias("duration_ms"), none("width").alias("width"), none("height").alias("height"),
        metadata_hash(video["name"], size).alias("metadata_hash"), kind.alias("analysis"), video["source_method"].alias("source_method"), F.coalesce(video["source_conflict"], F.lit(False)).alias("source_conflict"),
        F.when(early, F.lit(False)).otherwise(sizes["size_mismatch"]).alias("size_mismatch"), F.when(~early, sizes["size_delta_bytes"]).alias("size_delta_bytes"), F.when(~early, sizes["size_ratio"]).alias("size_ratio"),
    )


def fingerprints(videos: Column, *, on: bool = True, limit_mb: int = 100) -> Column:
    """The fingerprints of a message's videos, in their order; none where the comparison is off."""
    made = F.transform(videos, lambda v: fingerprint(v, limit_mb=limit_mb))
    return made if on else F.slice(made, 1, 0)


def is_usable(videos: Column) -> Column:
    """Whether a message's videos can be matched at all: by file, by frames, or by metadata where that is the analysis."""
    by = lambda v: v["sha256"].isNotNull() | (F.size(v["frame_hashes"]) > 0) | ((v["analysis"] == "metadata") & v["metadata_hash"].isNotNull())
    return F.coalesce(F.exists(videos, lambda v: F.coalesce(by(v), F.lit(False))), F.lit(False))


def _each(messages: DataFrame, history: DataFrame | None, group: str, order: str, videos: str, ts: str | None, sender: str | None) -> DataFrame:
    """One row a video, written once: all that follows reads it several times."""
    who = F.col(sender).cast("string") if sender else F.lit(None).cast("string")
    rows = with_history(messages, history, [F.col(group).alias("_g"), moment(ts, order).alias("_at"), F.col(order).cast("long").alias("_id"), who.alias("_sender"), F.col(videos).alias("_videos")])
    rows = coded(rows) if sender else rows.drop("_sender").withColumn("_code", F.lit(None).cast("int"))
    v = F.col("_v")
    framed = F.coalesce((F.size(v["frame_hashes"]) == FRAMES) & (v["duration_ms"] > 0), F.lit(False))
    each = rows.select("_g", "_at", "_id", "_code", "_now", (F.size("_videos") == 1).alias("_single"), F.explode("_videos").alias("_v"))
    return saved(each.select("_g", "_at", "_id", "_code", "_now", "_single", v["sha256"].alias("sha"), v["metadata_hash"].alias("meta"), (v["analysis"] == "metadata").alias("by_meta"), F.when(framed, v["frame_hashes"]).alias("frames"), F.when(framed, v["duration_ms"].cast("long")).alias("ms"), F.when(framed, F.xxhash64(v["frame_hashes"], v["duration_ms"])).alias("print")), "videos")


class _Prints:
    """The frames of videos as words of eight bytes, and how many digits each has (0: not hexadecimal)."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table
        self.at, self.id = times(table)
        self.code = table.column("_code").fill_null(-1).to_numpy()
        self.print, self.row = np.unique(table.column("print").to_numpy(), return_inverse=True)
        kept = table.take(pa.array(np.unique(self.row, return_index=True)[1]))  # equal prints are compared once
        self.ms = kept.column("ms").to_numpy()
        self.digits = kept.column("_digits").combine_chunks().flatten().to_numpy().reshape(-1, FRAMES)
        frames = kept.column("_bits").combine_chunks().flatten().to_pylist()
        width = max(8, -(-max(map(len, frames), default=0) // 8) * 8)
        self.words = np.frombuffer(b"".join(f.ljust(width, b"\0") for f in frames), np.uint64).reshape(len(self.ms), FRAMES, width // 8)


def _alike(a: _Prints, p: np.ndarray, b: _Prints, q: np.ndarray, place: int) -> np.ndarray:
    """Likeness of a place of prints p and q, indices that numpy broadcasts."""
    n = min(a.words.shape[2], b.words.shape[2])
    x, y, m, k = a.words[:, place], b.words[:, place], a.digits[p, place], b.digits[q, place]
    apart = sum(np.bitwise_count(x[p, w] ^ y[q, w]).astype(np.uint16) for w in range(n))
    return np.where((m == k) & (m > 0), 1 - apart / (4 * np.maximum(m, 1)), 0.0)


def _links(a: _Prints, b: _Prints, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The prints (of a, of b) that match and aren't equal.

    Of five frames four must be strong, so where all have the usual length a pair with two frames that aren't is left out; places are compared one by one for all pairs
    until few are left, and then for those alone."""
    longest = np.maximum(a.ms[:, None], b.ms[None])
    open_ = (np.abs(a.ms[:, None] - b.ms[None]) <= np.maximum(SLACK_MS, (longest * SLACK_SHARE).astype(np.int64))) & (a.print[:, None] != b.print[None])
    usual = a.words.shape[2] == b.words.shape[2] == FRAME_BITS // 64 and (a.digits == FRAME_BITS // 4).all() and (b.digits == FRAME_BITS // 4).all()
    if usual:
        weak, most = np.zeros(open_.shape, np.uint8), int((1 - STRONG) * FRAME_BITS + 1e-9)
        for place in range(FRAMES):
            apart = np.zeros(open_.shape, np.uint16)
            for w in range(FRAME_BITS // 64):
                apart += np.bitwise_count(a.words[:, place, w][:, None] ^ b.words[:, place, w][None])
            weak += apart > most
            if place and (weak <= FRAMES - STRONG_FRAMES).mean() < 0.1:
                break
        open_ &= weak <= FRAMES - STRONG_FRAMES
    p, q = np.nonzero(open_)
    total, strong = np.zeros(len(p)), np.zeros(len(p), np.int8)
    for place in range(FRAMES):
        each = _alike(a, p, b, q, place)
        total += each
        strong += each >= STRONG
    keep = (total / FRAMES >= threshold) & (strong >= STRONG_FRAMES)
    return p[keep], q[keep]


class _Near:
    """What the videos of a block meet by frames: the first (``senders`` False), or the senders."""

    def __init__(self, asks: pa.Table, window: int | None, threshold: float, senders: bool, most: int) -> None:
        self.tiles = [_Prints(asks.slice(k, TILE)) for k in range(0, asks.num_rows, TILE)]
        self.window, self.threshold, self.senders, self.most = window, threshold, senders, most
        self.first = [np.full((2, len(t.id)), -1) for t in self.tiles]
        self.found = [np.zeros(len(t.id), bool) for t in self.tiles]
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def _rows(self, a: _Prints, b: _Prints, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of a that are open, of b) whose prints match, where a's sees b's."""
        p, q = _links(a, b, self.threshold)
        linked = np.zeros((len(a.print), len(b.print)), bool)
        linked[p, q] = True
        mine, theirs = np.flatnonzero(linked.any(1)[a.row] & open_), np.flatnonzero(linked.any(0)[b.row])
        seen = before((a.at[mine], a.id[mine]), (b.at[theirs], b.id[theirs]), self.window, self.senders) & linked[np.ix_(a.row[mine], b.row[theirs])]
        i, j = np.nonzero(seen)
        return mine[i], theirs[j]

    def add(self, answers: pa.Table) -> pa.Table | None:
        for k in range(0, answers.num_rows, TILE):
            b = _Prints(answers.slice(k, TILE))
            for n, a in enumerate(self.tiles):
                if self.found[n].all() or b.at[0] > a.at.max() or (self.window is not None and b.at[-1] <= a.at.min() - self.window):
                    continue
                i, j = self._rows(a, b, ~self.found[n])
                if not len(i):
                    continue
                if self.senders:
                    known = b.code[j] >= 0
                    self.pairs.append(np.unique((n * TILE + i[known]).astype(np.int64) << 32 | b.code[j[known]]))
                    self.held += len(self.pairs[-1])
                else:  # answers come in order: the first is the earliest
                    i, at = np.unique(i, return_index=True)
                    self.found[n][i], self.first[n][:, i] = True, (b.at[j[at]], b.id[j[at]])
        if self.held > self.most:
            self.pairs = [np.unique(np.concatenate(self.pairs))]
            self.held = len(self.pairs[0])
            if self.held > self.most // 2:
                return self.end()
        return None

    def end(self) -> pa.Table | None:
        at, ids = (np.concatenate([getattr(t, c) for t in self.tiles]) for c in ("at", "id"))
        if self.senders:
            pairs = np.unique(np.concatenate([*self.pairs, np.zeros(0, np.int64)]))
            self.pairs, self.held = [], 0
            i, edge = np.unique(pairs >> 32, return_index=True)
            sets = [packed(c.tolist()) for c in np.split(pairs & 0xFFFFFFFF, edge[1:])] if len(i) else []
            first = np.full((2, len(i)), -1)
        else:
            i, sets, first = np.flatnonzero(np.concatenate(self.found)), None, np.concatenate(self.first, 1)
            first = first[:, i]
        none = pa.array(np.full(len(i), self.senders))
        hit = [pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(c, pa.int64())) for c in first]
        return pa.table({"_id": ids[i], "_at": at[i], "_kind": pa.array(np.ones(len(i)), pa.int32()), "first_at": hit[0], "first_id": hit[1], "n": pa.nulls(len(i), pa.int64()), "senders": pa.nulls(len(i), pa.binary()) if sets is None else pa.array(sets, pa.binary())})


def _usable(frame: Column) -> Column:
    return F.coalesce(frame.rlike("^[0-9a-fA-F]+$"), F.lit(False))


def _like_itself(threshold: float) -> Column:
    """Whether equal frames match; frames that aren't hexadecimal are like nothing."""
    n = F.size(F.filter("frames", _usable))
    return (n >= STRONG_FRAMES) & (n / FRAMES >= threshold) & ~F.exists("frames", lambda f: f.isNull())


def _framed(each: DataFrame) -> DataFrame:
    """Videos with frames, as binary."""
    bits = lambda f: F.when(_usable(f), F.unhex(F.when(F.length(f) % 2 == 1, F.concat(F.lit("0"), f)).otherwise(f))).otherwise(F.unhex(F.lit("")))
    rows = each.filter(F.col("print").isNotNull() & ~F.exists("frames", lambda f: f.isNull()))
    return rows.select("_g", "_at", "_id", "_now", "_code", "print", "ms", F.transform("frames", bits).alias("_bits"), F.transform("frames", lambda f: F.when(_usable(f), F.length(f)).otherwise(0)).alias("_digits"))


def _near(each: DataFrame, *, threshold: float, window: int | None, senders: bool, size: int = BLOCK, most: int = MOST) -> DataFrame:
    """``MET`` of the current videos with others that have other frames, but match."""
    return swept(*dealt(_framed(each), window=window, size=size), lambda asks: _Near(asks, window, threshold, senders, most), MET, order=["_at", "_id"])


def frame_links(each: DataFrame, *, threshold: float = 0.90) -> DataFrame:
    """(_g, p, q): prints p of current rows, and all prints q of their group whose frames match; a print is told by its frames and duration."""

    class Links:
        def __init__(self, asks: pa.Table) -> None:
            self.g, self.tiles = asks.column("_g")[:1], [_Prints(asks.slice(k, TILE)) for k in range(0, asks.num_rows, TILE)]

        def add(self, answers: pa.Table) -> pa.Table:
            b = _Prints(answers)
            found = [(a.print[p], b.print[q]) for a in self.tiles for p, q in [_links(a, b, threshold)]]
            p, q = (np.concatenate(c) for c in zip(*found))
            return pa.table({"_g": self.g.take(pa.array(np.zeros(len(p), np.int64))), "p": p, "q": q})

        def end(self) -> None:
            return None

    kinds = _framed(each)
    own = each.filter(F.col("_now") & F.col("print").isNotNull() & _like_itself(threshold)).select("_g", F.col("print").alias("p"), F.col("print").alias("q"))
    return own.unionByName(swept(*dealt(kinds, window=None), Links, f"_g {each.schema['_g'].dataType.simpleString()}, p long, q long", order=["print"])).distinct()


def _met(each: DataFrame, threshold: float, retention_s: int | None, senders: bool, some: bool) -> DataFrame:
    """``MET`` of current videos by tier: keys are files, equal frames, and metadata, which current videos ask for where they are known by that alone; frames that aren't equal are compared."""
    tiers = [(0, F.col("sha"), F.lit(True)), (1, F.when(_like_itself(threshold), F.col("print")).cast("string"), F.lit(True)), (2, F.col("meta"), F.coalesce("by_meta", F.lit(False)))]
    keys = F.filter(F.array(*[F.struct(F.lit(t).alias("_kind"), c.alias("_key"), (F.col("_now") & asks).alias("_asks")) for t, c, asks in tiers]), lambda x: x["_key"] != "")
    alone = F.col("_single") & F.col("print").isNull() & (F.size(F.filter("_keys", lambda x: x["_asks"])) == 1)
    rows = each.withColumn("_keys", keys).select("_g", "_at", "_id", "_code", alone.alias("_alone"), F.inline("_keys"))
    near = _near(each, threshold=threshold, window=None if retention_s is None else retention_s * SECOND, senders=senders)
    return meet(rows, retention_s=retention_s, senders=senders, some=some).unionByName(near)


def video_matches(messages: DataFrame, history: DataFrame | None = None, *, group: str, order: str, videos: str = "videos", threshold: float = 0.90, ts: str | None = None, retention_s: int | None = None) -> DataFrame:
    """(order, matched_id, match_type): the earliest earlier message of the group, within the retention, with a video of the same file; else of matching
    frames; else of the same metadata, where the current video is known by that alone.  Rows of ``history`` are matched with, but match nothing themselves."""
    met = _met(_each(messages, history, group, order, videos, ts, None), threshold, retention_s, False, history is not None).filter("first_id is not null")
    best = met.groupBy("_id").agg(F.min(F.struct("_kind", "first_at", "first_id")).alias("hit"))
    kind = messages.schema[order].dataType
    return best.select(F.col("_id").cast(kind).alias(order), F.col("hit.first_id").cast(kind).alias("matched_id"), F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("hit._kind") + 1).alias("match_type"))


def senders_by_video(messages: DataFrame, history: DataFrame | None = None, *, group: str, order: str, sender: str, videos: str = "videos", threshold: float = 0.90, ts: str | None = None, retention_s: int | None = None) -> DataFrame:
    """(order, unique_senders): distinct senders, empty ones left out, of messages within the retention, at or before each one, that match by any tier."""
    met = _met(_each(messages, history, group, order, videos, ts, sender), threshold, retention_s, True, history is not None)
    counts = sender_counts(met, "_id").withColumn(order, F.col("_id").cast(messages.schema[order].dataType)).drop("_id")
    return messages.select(order).join(counts, order, "left").fillna(0, ["unique_senders"])
