"""Which volumes of a crawl are done: state kept for each volume over a stream.

A volume is done when every page of its search was read, or every one before an
empty page; a lost page keeps it open until a later run brings it, over restarts
too.  Pages may come late, again and in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from prudentia.sources.crawl import PAGE_SIZE

PAGES = T.StructType([T.StructField("volume", T.IntegerType()), T.StructField("total", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("state", T.StringType())])
VOLUMES = "volume int, total int, n_read int, n_missing int, n_lost int, done boolean"


class _VolumePages(StatefulProcessor):
    """Of a volume: its total, a bit for each page read, a bit for each page that was
    lost at some time, and the first empty page.  One value, read and written once
    a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getValueState("pages", "total int, seen binary, lost binary, ended int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, seen, lost, ended = 0, 0, 0, -1
        if self._kept.exists():
            total, seen, lost, ended = self._kept.get()
            seen, lost = int.from_bytes(seen, "little"), int.from_bytes(lost, "little")
        for part in rows:
            for most, start, state in zip(part["total"], part["start"], part["state"], strict=True):
                total, page = max(total, int(most)), int(start) // PAGE_SIZE
                if state == "read":
                    seen |= 1 << page
                elif state == "empty":
                    ended = page if ended < 0 else min(ended, page)
                else:
                    lost |= 1 << page
        as_bytes = lambda x: x.to_bytes((x.bit_length() + 7) // 8, "little")
        self._kept.update((total, as_bytes(seen), as_bytes(lost), ended))
        pages = -(-total // PAGE_SIZE)
        wanted = pages if ended < 0 else max(min(pages, ended), seen.bit_length())  # a page read beyond an empty one puts it right
        missing = wanted - (seen & ((1 << wanted) - 1)).bit_count()
        yield pd.DataFrame({"volume": [key[0]], "total": [total], "n_read": [seen.bit_count()], "n_missing": [missing], "n_lost": [(lost & ~seen).bit_count()], "done": [missing == 0]})

    def close(self) -> None:
        pass


def completion(pages: DataFrame) -> DataFrame:
    """The state of each volume that a batch of ``pages`` (volume, total, start,
    state) says something of.  Rows with nulls say nothing."""
    known = pages.select(*PAGES.fieldNames()).where("volume IS NOT NULL AND total IS NOT NULL AND start >= 0 AND state IS NOT NULL")
    return known.groupBy("volume").transformWithStateInPandas(statefulProcessor=_VolumePages(), outputStructType=VOLUMES, outputMode="update", timeMode="none")


def mark_volumes(spark: SparkSession, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep ``folder/volumes`` from the pages that :func:`~prudentia.streaming.ingest.ingest_pages`
    has stored: a page counts after its records are in the logs, never before."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("seq", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/volumes/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stored = spark.readStream.schema(PAGES).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).parquet(f"{folder}/pages")
    return completion(stored).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each volume."""
    log = spark.read.schema(f"{VOLUMES}, seq long").option("recursiveFileLookup", True).parquet(f"{folder}/volumes")
    last = F.max_by(F.struct("total", "n_read", "n_missing", "n_lost", "done"), "seq").alias("s")
    return log.groupBy("volume").agg(last).select("volume", "s.*")


def done_volumes(spark: SparkSession, folder: str) -> str:
    """The done volumes as a crawl's option ``skip`` takes them: at most as many
    numbers as there are volumes."""
    rows = volumes(spark, folder).where("done").select("volume").collect()
    return ",".join(str(v) for v in sorted(r["volume"] for r in rows))
