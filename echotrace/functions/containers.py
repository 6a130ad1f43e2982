"""What an MP4 or QuickTime file says of its video, read from its boxes: only their heads and the movie box are read, never the media."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_MOVIE = 64 << 20
_BROKEN = (ValueError, IndexError, struct.error, ZeroDivisionError)


def boxes(read: Callable[[int, int], bytes], start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the bodies of the boxes between two places; ``read(at, n)`` gives bytes."""
    while start + 8 <= end:
        head = read(start, 16)
        size, kind = struct.unpack_from(">I4s", head)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", head, 8)[0], start + 16
        last = end if size == 0 else start + size
        if last < body or last > end:
            raise ValueError("a box that doesn't end")
        yield kind, body, last
        start = last


def _child(data: bytes, at: tuple[int, int], *path: bytes) -> tuple[int, int] | None:
    for name in path:
        found = next(((s, e) for kind, s, e in boxes(lambda a, n: data[a : a + n], *at) if kind == name), None)
        if found is None:
            return None
        at = found
    return at


def _duration(data: bytes, box: tuple[int, int] | None) -> float | None:
    """Seconds, by a movie's or a medium's head of 32- or 64-bit times; none where they aren't told."""
    if box is None:
        return None
    scale, length = struct.unpack_from(">IQ", data, box[0] + 20) if data[box[0]] == 1 else struct.unpack_from(">II", data, box[0] + 12)
    untold = (1 << 64) - 1 if data[box[0]] == 1 else (1 << 32) - 1
    return length / scale if scale and 0 < length < untold else None


def probe(read: Callable[[int, int], bytes], size: int) -> dict[str, int | None] | None:
    """duration_ms, width and height of the first video track; None without one, without a duration, or where boxes are broken."""
    try:
        movie = next(((s, e) for kind, s, e in boxes(read, 0, size) if kind == b"moov"), None)
        if movie is None or movie[1] - movie[0] > MOST_MOVIE:
            return None
        data = read(movie[0], movie[1] - movie[0])
        whole = 0, len(data)
        for kind, s, e in boxes(lambda a, n: data[a : a + n], *whole):
            if kind != b"trak":
                continue
            handler = _child(data, (s, e), b"mdia", b"hdlr")
            if handler is None or data[handler[0] + 8 : handler[0] + 12] != b"vide":
                continue
            seconds = _duration(data, _child(data, whole, b"mvhd")) or _duration(data, _child(data, (s, e), b"mdia", b"mdhd"))
            head = _child(data, (s, e), b"tkhd")
            width, height = (x >> 16 for x in struct.unpack_from(">II", data, head[1] - 8)) if head else (0, 0)
            return {"duration_ms": round(seconds * 1000), "width": width or None, "height": height or None} if seconds else None
    except _BROKEN:
        pass
    return None


def probe_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, duration_ms, width, height) of the files under ``path``; null where there is no video that can be read.  Spark lists the files; tasks read
    ranges of bytes, so files can be of any size.  The folder must be one that pyarrow can open (file, HDFS, S3, GCS)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[dict[str, Any]] = []
            for uri, size in zip(frame["path"], frame["size"], strict=True):
                try:
                    place, name = pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", quote(uri, safe="/:")))
                    with place.open_input_file(name) as file:
                        found = probe(lambda at, n: file.read_at(n, at), size)  # noqa: B023 - called at once
                except (OSError, pa.ArrowInvalid):
                    found = None
                out.append(found or {})
            told = pd.DataFrame({c: pd.array([x.get(c) for x in out], "Int64") for c in ("duration_ms", "width", "height")}, index=frame.index)
            yield pd.concat([frame, told], axis=1)

    return files.mapInPandas(each, "path string, size long, duration_ms long, width long, height long")
