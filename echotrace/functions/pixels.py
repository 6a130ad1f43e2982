"""Grey pixels of PNG and BMP files, and the small picture that a perceptual hash is made of, in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: fixed values: the weights of red, green and blue in grey (65536 together), and the bits of precision of resampling weights
GREY, BITS = (19595, 38470, 7471), 22
MOST_PIXELS = 1 << 27
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _luma(rgb: np.ndarray) -> np.ndarray:
    return ((rgb[..., :3].astype(np.int64) * GREY).sum(-1) + (1 << 15) >> 16).astype(np.uint8)


def _unfiltered(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG with their filters undone; ``step`` bytes lie between a pixel and its left neighbour."""
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for r in range(height):
        at = r * (stride + 1)
        kind, line = data[at], np.frombuffer(data, np.uint8, stride, at + 1)
        if kind == 0:
            row = line
        elif kind == 1:  # sums along each channel
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            row = np.cumsum(padded.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            row = line + above
        elif kind in (3, 4):
            now, up = bytearray(line.tobytes()), above.tobytes()
            for k in range(stride):
                a, b = now[k - step] if k >= step else 0, up[k]
                if kind == 3:
                    guess = a + b >> 1
                else:
                    c = up[k - step] if k >= step else 0
                    p, q, s = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= s else b if q <= s else c
                now[k] = now[k] + guess & 255
            row = np.frombuffer(bytes(now), np.uint8)
        else:
            raise ValueError("not a filter")
        out[r] = above = row
    return out


def _samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """Samples of packed rows; of 16 bits, the upper 8."""
    if depth == 16:
        return rows[:, ::2][:, : width * channels].reshape(len(rows), width, channels)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * channels * depth].reshape(len(rows), width * channels, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return rows[:, : width * channels].reshape(len(rows), width, channels)


def png(data: bytes) -> np.ndarray:
    """Grey pixels of a PNG that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    width, height, depth, color, _, _, interlaced = head
    channels = _CHANNELS[color]
    if interlaced or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("not read here")
    stride = -(-width * channels * depth // 8)
    rows = _unfiltered(zlib.decompress(b"".join(packed)), height, stride, max(1, channels * depth // 8))
    x = _samples(rows, width, depth, channels)
    if color == 3:
        return _luma(palette[x[..., 0]])
    if channels <= 2:
        return x[..., 0] if depth >= 8 else (x[..., 0].astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return _luma(x)


def bmp(data: bytes) -> np.ndarray:
    """Grey pixels of a BMP of 8, 24 or 32 bits without compression."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    start, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32) or (packing == 3 and bits != 32) or not 0 < width * abs(height) <= MOST_PIXELS:
        raise ValueError("not read here")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows if height < 0 else rows[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        return _luma(palette[rows[:, :width]][..., 2::-1])
    return _luma(rows[:, : width * bits // 8].reshape(len(rows), width, bits // 8)[..., 2::-1])


def decoded(data: bytes) -> np.ndarray | None:
    """Grey pixels, or None for other and broken files."""
    for read in (png, bmp):
        try:
            return read(data)
        except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error):
            continue
    return None


def _weights(size: int, wanted: int) -> np.ndarray:
    """(wanted, size): how much each value of a line counts for each of the wanted ones: Lanczos windows of three lobes, as wide as what one value stands for."""
    scale = size / wanted
    wide = max(scale, 1.0)
    out = np.zeros((wanted, size), np.int64)
    for k in range(wanted):
        middle = (k + 0.5) * scale
        first, last = max(0, int(middle - 3 * wide + 0.5)), min(size, int(middle + 3 * wide + 0.5))
        x = (np.arange(first, last) - middle + 0.5) / wide
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        w = w / w.sum() * (1 << BITS)
        out[k, first:last] = np.where(w < 0, np.ceil(w - 0.5), np.floor(w + 0.5))
    return out


def resized(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lines first, then columns, whole numbers from 0 to 255 in between."""
    fit = lambda x: np.clip(x + (1 << BITS - 1) >> BITS, 0, 255)
    across = fit(grey.astype(np.int64) @ _weights(grey.shape[1], width).T)
    return fit(_weights(grey.shape[0], height) @ across).astype(np.uint8)
