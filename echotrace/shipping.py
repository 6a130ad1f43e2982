"""Let executors import this package when it isn't installed there."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


#: tasks that hand texts to Python and back hold several batches at once
BATCH_BYTES = "4m"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application, and keep Arrow batches small in this session."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if context.applicationId in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="spark-ship-"))
    copy = folder / "src" / _ROOT.name
    shutil.copytree(_ROOT, copy, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / f"{_ROOT.name}_src"), "zip", copy.parent))
    _shipped.add(context.applicationId)
