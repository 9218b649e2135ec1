"""Storage that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession

_chosen: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.  Where that is unset,
    a local session gets a temporary folder, the same for all of its calls; on a
    cluster there is no folder to guess."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if context.applicationId not in _chosen:
            _chosen[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="prudentia-")
        root = _chosen[context.applicationId]
    return f"{root.rstrip('/')}/prudentia-{context.applicationId}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_dir` that no other call returns."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def let_go(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does when the
    driver collects its garbage, which may be long after the next job began."""
    gc.collect()
    spark._jvm.System.gc()


class Folder:
    """A folder of Hadoop's file systems, as the driver uses it for small files."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, prefix: str = "") -> list[str]:
        """The names in the folder that begin so, sorted; none if there is no folder."""
        if not self._fs.exists(self._at("")):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(n for n in found if n.startswith(prefix))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Put a file where none is; fails if another writer was first.  Readers see
        the whole file or none: it is written aside and renamed."""
        aside = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(aside, self._at(name)):
            self._fs.delete(aside, False)
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
