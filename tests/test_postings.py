"""Searches through the index against searches of all texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from echotrace.operators import postings
from echotrace.operators.search import ranked


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    draw = random.Random(4)
    words = ["橙色", "猫", "Night", "sky", "窗台", "a", "STRAßE", "ﬁsh", "red", "reed", "er"]
    rows = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 9))) if k % 11 else None, draw.choice(["2024-01-01", "2024-01-02", "2024-01-03"]), k % 17) for k in range(300)] + [(1000, " \n ", "2024-01-01", 1), (1001, "nigth sky", "2024-01-03", 1)]
    table = spark.createDataFrame(rows, "id long, text string, day string, ts long")
    path = str(tmp_path_factory.mktemp("postings"))
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):  # a day at a time
        postings.append(table.filter(F.col("day") == day), path, key="id", text="text", day="day")
    return table, path


@pytest.mark.parametrize("query", ["橙色 猫", "猫", "STRASSE", "re er", " ", "night sky red"])
@pytest.mark.parametrize("fuzzy_from", [None, 0.65])
def test_search_by_index_equals_search_of_all(spark, indexed, query, fuzzy_from):
    table, path = indexed
    want = ranked(table, query, text="text", order="id", recency="ts", fuzzy_from=fuzzy_from).collect()
    assert postings.search(table, path, query, key="id", text="text", recency="ts", fuzzy_from=fuzzy_from).collect() == want


def test_only_touched_buckets_are_read(spark, indexed):
    table, path = indexed
    left = postings.candidates(spark, path, "night", since="2024-01-02")
    plan = left._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[[^\]]*\]", plan).group(0)
    assert "bucket" in filters and "day" in filters
    runs = ["nig", "igh", "ght"]
    held = {r["bucket"] for r in spark.createDataFrame([(r,) for r in runs], "run string").select(F.pmod(F.xxhash64("run"), F.lit(postings.BUCKETS)).cast("int").alias("bucket")).collect()}
    assert set(map(int, re.findall(r"bucket#\d+ IN \(([\d,]+)\)|bucket#\d+ = (\d+)", plan)[0][0].split(","))) == held and len(held) <= 3
    assert left.count() < 100 and postings.candidates(spark, path, "猫", fuzzy_from=0.1) is not None
    assert postings.candidates(spark, path, "ab", fuzzy_from=0.0) is None
