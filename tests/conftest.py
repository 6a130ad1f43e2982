import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-test-")
    session = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.local.dir", folder).config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 9)
    return x.item() if hasattr(x, "item") else x


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL on the smallest tables, whatever the order of rows."""

    def compare(query, sql):
        ours = query(spark, SF)
        theirs = duck.sql(sql)
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        a = sorted((tuple(_plain(r[c]) for c in columns) for r in ours.collect()), key=str)
        at = [theirs.columns.index(c) for c in columns]
        b = sorted((tuple(_plain(r[k]) for k in at) for r in theirs.fetchall()), key=str)
        assert a == b

    return compare
