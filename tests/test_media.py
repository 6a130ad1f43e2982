"""Images and containers from bytes that are built here, against plain loops."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from echotrace.functions import containers, images, pixels


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(rows, width, color, depth, filters, palette=None):
    """``rows``: packed bytes of each line."""
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color] * depth // 8)
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, filters):
        line = bytearray()
        for k, x in enumerate(row):
            a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind]) + bytes(line)
        above = row
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, color, 0, 0, 0))]
    parts += [chunk(b"PLTE", palette)] if palette else []
    packed = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + b"".join([*parts, chunk(b"IDAT", packed[:9]), chunk(b"IDAT", packed[9:]), chunk(b"IEND", b"")])


def luma(r, g, b):
    return (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16


@pytest.mark.parametrize("color,depth", [(0, 8), (0, 1), (0, 4), (0, 16), (2, 8), (3, 8), (3, 2), (4, 8), (6, 8), (6, 16)])
def test_png_pixels(color, depth):
    draw, width, height = random.Random(color * 20 + depth), 13, 9
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    palette = bytes(draw.randrange(256) for _ in range(3 << min(depth, 8)))
    values = [[draw.randrange(1 << depth) for _ in range(width * channels)] for _ in range(height)]
    rows = []
    for line in values:
        bits = "".join(f"{v:0{depth}b}" for v in line)
        bits += "0" * (-len(bits) % 8)
        rows.append(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)))
    got = pixels.png(encode_png(rows, width, color, depth, [draw.randrange(5) for _ in rows], palette if color == 3 else None))
    for line, mine in zip(values, got.tolist()):
        eight = [v >> 8 for v in line] if depth == 16 else line
        for k in range(width):
            p = eight[k * channels : (k + 1) * channels]
            want = luma(*palette[3 * p[0] : 3 * p[0] + 3]) if color == 3 else luma(*p[:3]) if channels > 2 else p[0] * 255 // ((1 << depth) - 1) if depth < 8 else p[0]
            assert mine[k] == want


@pytest.mark.parametrize("bits", [8, 24, 32])
@pytest.mark.parametrize("up", [True, False])
def test_bmp_pixels(bits, up):
    draw, width, height = random.Random(bits), 7, 5
    palette = bytes(draw.randrange(256) for _ in range(1024)) if bits == 8 else b""
    rows = [bytes(draw.randrange(256) for _ in range(width * bits // 8)) for _ in range(height)]
    body = b"".join(r + b"\0" * (-len(r) % 4) for r in (rows[::-1] if up else rows))
    head = struct.pack("<IiiHHIIiiII", 40, width, height if up else -height, 1, bits, 0, 0, 0, 0, 0, 0)
    data = b"BM" + struct.pack("<IHHI", 54 + len(palette) + len(body), 0, 0, 54 + len(palette)) + head + palette + body
    for row, mine in zip(rows, pixels.bmp(data).tolist()):
        for k in range(width):
            b, g, r = palette[4 * row[k] : 4 * row[k] + 3] if bits == 8 else row[k * bits // 8 : k * bits // 8 + 3]
            assert mine[k] == luma(r, g, b)


@pytest.mark.parametrize("width,height", [(17, 16), (40, 33), (5, 4), (300, 90)])
def test_small_picture_equals_a_plain_loop(width, height):
    grey = np.random.default_rng(width).integers(0, 256, (height, width)).astype(np.uint8)

    def lanczos(x):
        return 0.0 if abs(x) >= 3 else 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)

    def line(values, wanted):
        scale = len(values) / wanted
        wide, out = max(scale, 1.0), []
        for k in range(wanted):
            middle = (k + 0.5) * scale
            places = range(max(0, int(middle - 3 * wide + 0.5)), min(len(values), int(middle + 3 * wide + 0.5)))
            w = [lanczos((p - middle + 0.5) / wide) for p in places]
            whole = [round(x / sum(w) * 2**22) for x in w]
            out.append(min(255, max(0, (sum(a * int(values[p]) for a, p in zip(whole, places)) + 2**21) >> 22)))
        return out

    across = np.array([line(row, 17) for row in grey])
    want = np.array([line(column, 16) for column in across.T]).T
    assert (pixels.resized(grey, 17, 16) == want).all()


def test_image_hashes_of_files(spark, tmp_path):
    ramp = [bytes(255 - 6 * k for k in range(40)) for _ in range(30)]
    files = {"falling.png": encode_png(ramp, 40, 0, 8, [1] * 30), "rising.png": encode_png([r[::-1] for r in ramp], 40, 0, 8, [4] * 30), "cut.png": encode_png(ramp, 40, 0, 8, [0] * 30)[:60], "other.jpg": b"\xff\xd8\xff", "empty.png": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/")[-1]: r["image_hash"] for r in images.image_hashes(spark, str(tmp_path)).collect()}
    assert got["falling.png"] == "f" * 64 and got["rising.png"] == "0" * 64
    assert all(got[n] == hashlib.md5(files[n]).hexdigest() for n in ("cut.png", "other.jpg")) and "empty.png" not in got


def box(kind, body, wide=False):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def movie(seconds=12.5, wide=False, video=True, told=True, size=(1920, 1080)):
    def head(kind, scale, length):
        return box(kind, struct.pack(">B3xQQIQ", 1, 0, 0, scale, length) + bytes(80) if wide else struct.pack(">B3xIIII", 0, 0, 0, scale, length) + bytes(80), wide)

    def track(handler, w, h):
        tkhd = box(b"tkhd", bytes(76) + struct.pack(">II", w << 16, h << 16))
        return box(b"trak", tkhd + box(b"mdia", head(b"mdhd", 600, int(seconds * 600)) + box(b"hdlr", bytes(8) + handler + bytes(13))), wide)

    length = int(seconds * 1000) if told else ((1 << 64) - 1 if wide else (1 << 32) - 1)
    tracks = track(b"soun", 0, 0) + (track(b"vide", *size) if video else b"")
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(5000), wide) + box(b"moov", head(b"mvhd", 1000, length) + tracks, wide)


def test_probe_of_built_files(spark, tmp_path):
    whole = {"duration_ms": 12500, "width": 1920, "height": 1080}
    of = lambda data: containers.probe(lambda at, n: data[at : at + n], len(data))
    for wide in (False, True):
        assert of(movie(wide=wide)) == of(movie(wide=wide, told=False)) == whole
        assert of(movie(wide=wide, video=False)) is None and of(movie(0, wide=wide)) is None
        assert of(movie(wide=wide, size=(0, 0))) == {**whole, "width": None, "height": None}
        data = movie(wide=wide)
        for cut in range(0, len(data), 37):
            assert of(data[:cut]) is None or cut > 5000
    draw = random.Random(1)
    for _ in range(300):  # whatever stands there, nothing is raised
        data = bytearray(movie())
        for _ in range(5):
            data[draw.randrange(len(data))] = draw.randrange(256)
        of(bytes(data))
    asked = []
    data = movie()
    containers.probe(lambda at, n: asked.append(n) or data[at : at + n], len(data))
    assert sum(asked) < 1200  # the media stay where they are
    (tmp_path / "a b.mp4").write_bytes(data)
    (tmp_path / "bad.mp4").write_bytes(b"nothing")
    got = {r["path"].rsplit("/")[-1]: tuple(r)[1:] for r in containers.probe_files(spark, str(tmp_path)).collect()}
    assert got == {"a b.mp4": (len(data), 12500, 1920, 1080), "bad.mp4": (7, None, None, None)}
