"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()
#: Bytes up to which rows go to a Python worker as one batch; a larger row is a
#: batch of its own.  Spark's own limit is 64 MB, which each task holds several
#: times: in the JVM outside its heap, in the worker, and while buffers double.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the batches that go to Python workers, if the session doesn't."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, and bound the batches
    that they get.

    Nothing is shipped where the path of the workers has it already; elsewhere its
    sources go to the executors as a zip file, once per application.
    """
    small_batches(spark)
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if _ROOT in paths or context.applicationId in _shipped:
        return spark
    handle, name = tempfile.mkstemp(prefix="prudentia-", suffix=".zip")
    with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w") as archive:
        for source in sorted((_ROOT / "prudentia").rglob("*.py")):
            archive.write(source, source.relative_to(_ROOT))
    context.addPyFile(name)
    _shipped.add(context.applicationId)
    return spark
