"""Perceptual hashes of images from their pixels, and hashes of files."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions.pixels import decoded, resized

#: fixed values: a grey image of this size gives 256 bits
WIDTH, HEIGHT = 17, 16


def dhash(pixels: Column) -> Column:
    """64 hexadecimal digits of a grey image's 17 x 16 values, by rows: a bit is set where a value is above its right neighbour's; null for other sizes."""
    row = lambda r: F.slice(pixels, r * WIDTH + 1, WIDTH)
    bits = lambda r: F.transform(F.sequence(F.lit(1), F.lit(WIDTH - 1)), lambda c: (F.element_at(row(r), c) > F.element_at(row(r), c + 1)).cast("int").cast("string"))
    digits = lambda r: F.lpad(F.lower(F.conv(F.array_join(bits(r), ""), 2, 16)), (WIDTH - 1) // 4, "0")
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), digits), "")
    return F.when(F.size(pixels) == WIDTH * HEIGHT, made)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, md5) of files; md5 stands in for an image hash where there are no pixels."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def image_hash(content: Column) -> Column:
    """The perceptual hash of an encoded image (PNG or BMP); the MD5 of what can't be decoded, null for null."""

    @F.pandas_udf("string")
    def each(contents: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            if data is None:
                return None
            grey = decoded(data)
            if grey is None:
                return hashlib.md5(data, usedforsecurity=False).hexdigest()
            small = resized(grey, WIDTH, HEIGHT)
            return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()

        return contents.map(one)

    return each(content)


def image_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, image_hash) of the files under ``path``, decoded where they are read; Spark has no rows for empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), image_hash(F.col("content")).alias("image_hash"))
