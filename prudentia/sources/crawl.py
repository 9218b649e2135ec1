"""A Spark data source over stored answers of a paged API of court records.

A crawl asks how many volumes there are, searches each volume for its number of
records and fetches these ten at a time.  What the API answered is stored, run by
run, and replayed here::

    run=<k>/total/...               the number of volumes, plain text
    run=<k>/searches/volume=<v>/... the search's page, which names the total
    run=<k>/pages/volume=<v>/...    a JSON line for each page: {"start", "attempts":
                                    [{"status", "body"}, ...]}
    run=<k>/_DONE                   put last; runs without it aren't read

``spark.read.format("stored_crawl")`` plans one input partition for each run and
volume: totals are read when it plans, and conditions on ``volume`` leave whole
volumes out before anything of them is opened.  The stream reads the runs that
came since its last batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from prudentia.sources.shared import Folder

# How the API names a search's total, how many records a page has
# and how often a page is asked for.
TOTAL = re.compile(r'var totalResultados = "(\d+)"')
PAGE_SIZE = 10
ATTEMPTS = 3

SCHEMA = T.StructType(
    [
        T.StructField("run", T.LongType()),
        T.StructField("volume", T.IntegerType()),
        T.StructField("total", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("record", T.StringType()),
    ]
)
_HOLDS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
}


def scraped_total(html: str) -> int:
    """How many records a search's page names; 0 if it names none."""
    found = TOTAL.search(html)
    return int(found[1]) if found else 0


def replayed(attempts: list[dict], most: int = ATTEMPTS) -> list | None:
    """The records of a page from what was answered, or None for a lost page.

    A server's error (5xx, or status 0 for a broken connection) is followed by
    another attempt, up to ``most``.  401 says that the session forgot the search:
    it is run again, once, and the page asked for anew.  Other errors and bodies
    that aren't JSON lose the page; JSON other than a list is an empty page.
    """
    failed, renewed = 0, False
    for answer in attempts:
        status = answer.get("status") or 0
        if status == 401 and not renewed:
            failed, renewed = 0, True
        elif status >= 500 or status == 0:
            failed += 1
            if failed >= most:
                return None
        elif status >= 400:
            return None
        else:
            try:
                body = json.loads(answer.get("body") or "")
            except ValueError:
                return None
            return body if isinstance(body, list) else []
    return None


def has_position(record: object) -> bool:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    return isinstance(record, dict) and whole(record.get("tomo")) and whole(record.get("pagina"))


@dataclass
class VolumePartition(InputPartition):
    run: int
    volume: int
    total: int


class _Crawl:
    """The stored runs, as the planner and the tasks see them."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        low, dash, high = options.get("volumes", "").partition("-")
        self._range = (int(low), int(high if dash else low)) if low else None
        self._skip = {int(v) for v in options.get("skip", "").split(",") if v.strip()}
        self._limit = int(options["limit"]) if options.get("limit") else None
        self._attempts = int(options.get("attempts", ATTEMPTS))
        self.filters: list[Filter] = []

    def _files(self, folder: str) -> list[str]:
        found = self._fs().get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")

    def _fs(self) -> pafs.FileSystem:
        return pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pafs.LocalFileSystem()

    def _root(self) -> str:
        return pafs.FileSystem.from_uri(self.path)[1] if "://" in self.path or self.path.startswith("file:") else self.path

    def _text(self, folder: str) -> str:
        fs = self._fs()
        return "".join(fs.open_input_stream(f).read().decode() for f in self._files(folder))

    def runs(self) -> list[int]:
        found = self._fs().get_file_info(pafs.FileSelector(self._root(), allow_not_found=True))
        numbers = [int(m[1]) for f in found if (m := re.fullmatch(r"run=(\d+)", f.base_name))]
        done = self._fs().get_file_info([f"{self._root()}/run={k}/_DONE" for k in numbers])
        return sorted(k for k, f in zip(numbers, done, strict=True) if f.type == pafs.FileType.File)

    def asked(self, volume: int) -> bool:
        if volume in self._skip or (self._range and not self._range[0] <= volume <= self._range[1]):
            return False
        return all(f.value is not None and _HOLDS[type(f)](volume, f.value) for f in self.filters)

    def planned(self, runs: list[int]) -> list[VolumePartition]:
        """A partition for each volume up to the run's number of volumes that is asked
        for and has records.  Searches are small files, one for a volume."""
        out = []
        for run in runs:
            top = f"{self._root()}/run={run}"
            volumes = int(self._text(f"{top}/total").strip() or 0)
            searched = self._fs().get_file_info(pafs.FileSelector(f"{top}/searches", allow_not_found=True))
            there = sorted(int(m[1]) for f in searched if (m := re.fullmatch(r"volume=(\d+)", f.base_name)))
            for volume in there:
                if volume <= volumes and self.asked(volume):
                    total = scraped_total(self._text(f"{top}/searches/volume={volume}"))
                    if total:
                        out.append(VolumePartition(run, volume, total if self._limit is None else min(total, self._limit)))
        return out

    def rows(self, part: VolumePartition | None) -> Iterator[tuple]:
        """The records of a volume, page by page up to the first empty one.  A page
        that keeps no record is one row without a record."""
        if part is None:
            return
        exchanges: dict[int, list] = {}
        fs = self._fs()
        for name in self._files(f"{self._root()}/run={part.run}/pages/volume={part.volume}"):
            for line in fs.open_input_stream(name).read().splitlines():
                if line.strip():
                    one = json.loads(line)
                    exchanges.setdefault(int(one["start"]), []).extend(one.get("attempts") or [])
        for start in range(0, part.total, PAGE_SIZE):
            records = replayed(exchanges.get(start, []), self._attempts)
            state = "lost" if records is None else "read" if records else "empty"
            head = (part.run, part.volume, part.total, start, state)
            kept = [(i, r) for i, r in enumerate(records or []) if has_position(r)]
            yield from ((*head, i, json.dumps(r, ensure_ascii=False)) for i, r in kept) if kept else [(*head, None, None)]
            if state == "empty":
                return


class CrawlReader(DataSourceReader):
    def __init__(self, crawl: _Crawl):
        self._crawl = crawl

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if type(one) in _HOLDS and tuple(one.attribute) == ("volume",):
                self._crawl.filters.append(one)
            else:
                yield one

    def partitions(self) -> list[VolumePartition]:
        return self._crawl.planned(self._crawl.runs())

    def read(self, partition: VolumePartition | None) -> Iterator[tuple]:
        return self._crawl.rows(partition)


class CrawlStreamReader(DataSourceStreamReader):
    """Offsets are runs: a batch has the runs that were done since the last."""

    def __init__(self, crawl: _Crawl):
        self._crawl = crawl

    def initialOffset(self) -> dict:
        return {"run": -1}

    def latestOffset(self) -> dict:
        return {"run": max(self._crawl.runs(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[VolumePartition]:
        return self._crawl.planned([k for k in self._crawl.runs() if start["run"] < k <= end["run"]])

    def read(self, partition: VolumePartition | None) -> Iterator[tuple]:
        return self._crawl.rows(partition)


class StoredCrawl(DataSource):
    """Options: ``path``; ``volumes`` (``330-349`` or ``332``); ``skip`` (volumes,
    comma-joined, that are done); ``limit`` (records of a volume from which on no
    page is read); ``attempts``."""

    @classmethod
    def name(cls) -> str:
        return "stored_crawl"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> CrawlReader:
        return CrawlReader(_Crawl(dict(self.options)))

    def streamReader(self, schema: T.StructType) -> CrawlStreamReader:
        return CrawlStreamReader(_Crawl(dict(self.options)))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known and let conditions reach it."""
    spark.dataSource.register(StoredCrawl)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_crawl(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The rows of a stored crawl (see the module and :class:`StoredCrawl`)."""
    return register(spark).read.format("stored_crawl").options(**options).load(path)


def stream_crawl(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return register(spark).readStream.format("stored_crawl").options(**options).load(path)


def store_run(spark: SparkSession, path: str, run: int, volumes: int, searches: DataFrame, pages: DataFrame) -> None:
    """Store what a run was answered: ``searches`` (volume, html) and ``pages``
    (volume, start, attempts array<struct<status, body>>).  A run is written once
    and seen when whole."""
    top = f"{path.rstrip('/')}/run={run}"
    line = F.to_json(F.struct("start", "attempts"))
    searches.select("volume", F.translate("html", "\n", " ").alias("value")).repartition("volume").write.partitionBy("volume").text(f"{top}/searches")
    pages.select("volume", "start", line.alias("value")).repartition("volume").sortWithinPartitions("volume", "start").select("volume", "value").write.partitionBy("volume").text(f"{top}/pages")
    spark.range(1).coalesce(1).select(F.lit(str(volumes)).alias("value")).write.text(f"{top}/total")
    Folder(spark, top).create("_DONE", "")
