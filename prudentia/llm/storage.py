"""Shared storage for intermediate tables and files.

Everything that one task writes and another reads goes below the folder the
cluster names in ``spark.checkpoint.dir``.  Only where that is unset (tests,
a laptop) is a temporary folder chosen.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_chosen: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in the storage all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _chosen:  # the setting can't be made while Spark runs
            _chosen[application] = "file://" + tempfile.mkdtemp(prefix="prudentia-")
        root = _chosen[application]
    return f"{root.rstrip('/')}/prudentia-{spark.sparkContext.applicationId}"


#: Folders of the open :func:`scratch` blocks, the innermost last.
_scratch: list[list[str]] = []


def new_dir(spark: SparkSession, name: str, stays: bool = False) -> str:
    """A path below :func:`shared_dir` that no other call returns.  ``stays``: it
    outlasts the innermost :func:`scratch` block."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    blocks = _scratch[:-1] if stays else _scratch
    if blocks:
        blocks[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to new folders in the block is deleted at its end, and the
    shuffle files of its jobs are let go; what has to outlast it ``stays``."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            discard(spark, path)
        release(spark)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts the lineage, so
    that a lost executor costs only the reading tasks.  ``stays``: it outlasts
    the innermost :func:`scratch` block."""
    path = new_dir(df.sparkSession, name, stays)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does when the
    driver collects its garbage, which may be long after the next job began.

    Executors collect theirs too and hand freed heap back to the system: a heap
    that has grown to its limit by what ended tasks left would stand beside the
    Python workers of every later stage.
    """
    gc.collect()
    spark._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def aside(df: DataFrame, added: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns whose names, in any case, an operator adds moved out
    of the way: they come back with ``_input`` behind their names, as often as it
    takes.  Columns in ``keep`` are an operator's arguments and stay."""
    taken = {c.lower() for c in added}
    names = {c.lower() for c in df.columns}
    out = []
    for c in df.columns:
        new = c
        while new.lower() in taken or (new != c and new.lower() in names):
            new += "_input"
        if c in keep and new != c:
            raise ValueError(f"{c} is a column that this operator adds")
        names.add(new.lower())
        out.append(new)
    return df.toDF(*out)
