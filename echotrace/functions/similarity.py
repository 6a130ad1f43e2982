"""Similarities: cosine of vectors, Hamming of hexadecimal hashes, frames of videos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9
# fixed values: how alike the frames of two videos are, and how far durations may differ
FRAMES, STRONG_FRAMES, STRONG, SLACK_MS, SLACK_SHARE = 5, 4, 0.85, 1000, 0.03


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """With norms computed once a row; 0 for empty vectors and those of different lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot / (norm_a * norm_b + EPSILON)).otherwise(0.0)


def hex_similarity(a: Column, b: Column) -> Column:
    """1 - Hamming distance / bits; 0 for other lengths, empty or non-hexadecimal hashes."""
    usable = (F.length(a) == F.length(b)) & (F.length(a) > 0) & a.rlike("^[0-9a-fA-F]+$") & b.rlike("^[0-9a-fA-F]+$")
    word = lambda h, k: F.conv(F.substr(h, k * 16 + 1, F.lit(16)), 16, -10).cast("bigint")
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(a) / 16).cast("int") - 1, F.lit(0)))
    bits = F.aggregate(words, F.lit(0), lambda s, k: s + F.bit_count(word(a, k).bitwiseXOR(word(b, k))))
    return F.when(usable, 1 - bits / (4 * F.length(a))).otherwise(0.0)


def frames_match(a: Column, b: Column, ms_a: Column, ms_b: Column, threshold: float = 0.90) -> Column:
    """Five frame hashes each, durations near, the mean similarity at the threshold and four frames strong."""
    each = F.zip_with(a, b, hex_similarity)
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / FRAMES
    longest = F.greatest(ms_a, ms_b)
    near = F.abs(ms_a - ms_b) <= F.greatest(F.lit(SLACK_MS), (longest * SLACK_SHARE).cast("int"))
    return F.coalesce((F.size(a) == FRAMES) & (F.size(b) == FRAMES) & (ms_a > 0) & (ms_b > 0) & near & (mean >= threshold) & (F.size(F.filter(each, lambda x: x >= STRONG)) >= STRONG_FRAMES), F.lit(False))
