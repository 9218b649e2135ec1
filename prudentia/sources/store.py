"""A stored graph: clustered snapshots, a log beside them, commits by manifest.

A table is cut into ranges of its key by bounds that never move.  Each range has
base files, sorted by key, and the log of what was merged since.  A merge writes
log files for the ranges it touches and nothing else; compaction folds a range's
log into new base files once it has grown to a share of the base; a batch that
makes it grow so far is folded with it at once, without a log.  Files are never
overwritten: a commit is a new manifest that names the files which make up the
graph, and whoever has opened an older one goes on reading that.

Edges are kept twice, by cited and by citing ruling, so that questions in either
direction open one range.
"""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_right
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prudentia.operators.upserts import fold_aliases, fold_citations, fold_rulings
from prudentia.schema import ALIASES, CITATIONS, RULINGS
from prudentia.sources.shared import Folder, let_go

#: Rows that a range is made for, and ranges of a table at most: bounds are a part
#: of every plan and every manifest.
ROWS, RANGES = 2_000_000, 512
#: Keys sampled for each range to find its bounds.
SAMPLED = 64
#: A range is compacted once its log has this share of its base's rows.
SHARE = 0.2
_DIR = "spark.prudentia.graph.dir"


class GraphUnavailable(RuntimeError):
    """There is no graph where one was expected."""


class CommitConflict(RuntimeError):
    """Another writer committed first; nothing of this write is visible."""


class _Table:
    def __init__(self, schema: T.StructType, key: str, fold: Callable[..., DataFrame], sort: list[str]):
        self.schema, self.key, self._fold, self.sort = schema, key, fold, sort

    def fold(self, log: DataFrame, order: list[str], also: tuple[str, ...] = ()) -> DataFrame:
        return self._fold(log, order, also).select(*self.schema.fieldNames(), *also)


TABLES = {
    "rulings": _Table(RULINGS, "id", fold_rulings, ["id"]),
    "citations": _Table(CITATIONS, "cited_id", partial(fold_citations, key=("cited_id", "citing_id", "quote")), ["cited_id", "citing_id", "quote"]),
    "citing": _Table(CITATIONS, "citing_id", fold_citations, ["citing_id", "cited_id", "quote"]),
    "aliases": _Table(ALIASES, "raw", fold_aliases, ["raw"]),
}


def graph_dir(spark: SparkSession) -> str:
    """Where the graph is: the session's ``spark.prudentia.graph.dir``, else the
    environment's PRUDENTIA_GRAPH_DIR, else ``graph``."""
    return spark.conf.get(_DIR, None) or os.environ.get("PRUDENTIA_GRAPH_DIR") or "graph"


def range_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds are at most ``key``, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(bounds[mid]), between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(bounds))


def bounds_for(rows: DataFrame, key: str, ranges: int, total: int) -> list[str]:
    """Keys that cut ``rows`` into about equal ranges, from a sample of at most
    twice 64 keys a range; a key as common as several ranges is a range of its own."""
    if ranges < 2:
        return []
    wanted = ranges * SAMPLED
    sampled = rows if total <= wanted else rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(total)) < wanted)
    keys = sorted(r[0] for r in sampled.where(F.col(key).isNotNull()).select(key).limit(2 * wanted).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


class GraphStore:
    """The graph in ``folder`` as its last commit left it, or as commit ``version``
    did.  :meth:`merge` and :meth:`compact` give the store after them."""

    def __init__(self, spark: SparkSession, folder: str | None = None, version: int | None = None):
        self.spark, self.folder = spark, (folder or graph_dir(spark)).rstrip("/")
        self._manifests = Folder(spark, f"{self.folder}/_manifest")
        names = self._manifests.names()
        names = [n for n in names if n.isdigit() and (version is None or int(n) == version)]
        if not names:
            raise GraphUnavailable(f"no graph in {self.folder}: build one first (GraphStore.create)")
        self.manifest = json.loads(self._manifests.read(names[-1]))
        self.version: int = self.manifest["version"]

    @staticmethod
    def create(spark: SparkSession, folder: str, rulings: DataFrame, citations: DataFrame, aliases: DataFrame | None = None, order: list[str] | None = None, rows: int = ROWS) -> GraphStore:
        """Store a graph.  Rows that say something of the same key are folded in
        ``order`` (columns); a table without these has unique keys."""
        aliases = spark.createDataFrame([], ALIASES) if aliases is None else aliases
        manifest = {"version": 0, "meta": {}, "tables": {}}
        store = object.__new__(GraphStore)
        store.spark, store.folder, store.manifest, store.version = spark, folder.rstrip("/"), manifest, -1
        store._manifests = Folder(spark, f"{store.folder}/_manifest")
        for name, given in (("rulings", rulings), ("citations", citations), ("citing", citations), ("aliases", aliases)):
            table = TABLES[name]
            ready, by = _ready(given, table, order)
            total = ready.count()
            bounds = bounds_for(ready, table.key, min(RANGES, -(-total // rows)), total)
            manifest["tables"][name] = {"bounds": bounds, "ranges": [{"base": [], "log": [], "base_rows": 0, "log_rows": 0} for _ in range(len(bounds) + 1)]}
            for k, (path, n) in store._write(name, ready, by).items():
                manifest["tables"][name]["ranges"][k] |= {"base": [path], "base_rows": n}
        return store._commit(manifest)

    def _commit(self, manifest: dict) -> GraphStore:
        manifest["version"] = self.version + 1
        try:
            self._manifests.create(f"{manifest['version']:012d}", json.dumps(manifest))
        except FileExistsError as error:
            raise CommitConflict(f"{self.folder} has moved beyond commit {self.version}") from error
        return GraphStore(self.spark, self.folder, manifest["version"])

    def _write(self, name: str, rows: DataFrame, order: list[str] | None = None, seq: int | None = None) -> dict[int, tuple[str, int]]:
        """Write sorted files for the ranges of ``rows``, folded in ``order`` and
        marked ``seq`` if these are given: {range: (folder, rows)}.

        The exchange is by range, key and the rest of the sort, so one ruling that
        a third of all edges cite is dealt to many tasks.  What is folded into one
        row then lies in one task already: the fold has no exchange of its own.
        """
        table, bounds = TABLES[name], self.manifest["tables"][name]["bounds"]
        top = f"{name}/{uuid.uuid4().hex}"
        # The one range of a table without bounds is a constant, by which the fold would deal its rows again.
        of = ("range",) if bounds else ()
        ranged = rows.withColumn("range", range_of(F.col(table.key), bounds)).repartitionByRange(*of, *table.sort)
        if order:
            ranged = table.fold(ranged, order, of).withColumn("range", F.col("range") if of else F.lit(0))
        if seq is not None:
            ranged = ranged.withColumn("seq", F.lit(seq).cast("long"))
        ranged = ranged.sortWithinPartitions("range", *table.sort)
        # Without the adaptive size each filter has a megabyte, whatever it holds.
        writer = ranged.write.partitionBy("range").option("maxRecordsPerFile", 1_000_000).option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in {"rulings": ["id"], "citations": ["citing_id", "cited_id"], "citing": ["citing_id", "cited_id"], "aliases": ["raw", "ruling_id"]}[name]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.folder}/{top}")
        written = self.spark.read.schema(T.StructType([*ranged.schema.fields])).parquet(f"{self.folder}/{top}")
        found = {r["range"]: (f"{top}/range={r['range']}", r["n"]) for r in written.groupBy("range").agg(F.count("*").alias("n")).collect()}
        del ranged, writer, written
        let_go(self.spark)
        return found

    def _read(self, name: str, parts: list[dict], kind: str, extra: str = "") -> DataFrame:
        schema = TABLES[name].schema if not extra else T.StructType([*TABLES[name].schema.fields, T.StructField(extra, T.LongType())])
        paths = [f"{self.folder}/{p}" for part in parts for p in part[kind]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, name: str, wanted: list[int] | None = None, where: Column | None = None) -> DataFrame:
        """The table's rows in some ranges: ranges without a log as they are, others
        folded.  ``where`` may ask for the table's key columns only, and goes below
        the fold."""
        ranges = self.manifest["tables"][name]["ranges"]
        parts = ranges if wanted is None else [ranges[k] for k in wanted]
        asked = (lambda df: df) if where is None else (lambda df: df.where(where))
        clean = asked(self._read(name, [p for p in parts if not p["log"]], "base"))
        dirty = [p for p in parts if p["log"]]
        if not dirty:
            return clean
        folded = TABLES[name].fold(asked(self._writes(name, dirty)), ["seq"])
        return folded if len(dirty) == len(parts) else clean.unionByName(folded)

    def _writes(self, name: str, parts: list[dict]) -> DataFrame:
        """What base and log of some ranges hold, not folded, with its ``seq``."""
        return self._read(name, parts, "base").withColumn("seq", F.lit(-1).cast("long")).unionByName(self._read(name, parts, "log", "seq"))

    def table(self, name: str) -> DataFrame:
        """All rows of a table."""
        return self._rows(name)

    def lookup(self, name: str, key: str) -> DataFrame:
        """The rows of one key: one range is opened, and of its files the row groups
        that may hold the key."""
        return self._rows(name, [bisect_right(self.manifest["tables"][name]["bounds"], key)], F.col(TABLES[name].key) == F.lit(key))

    def matching(self, name: str, keys: DataFrame, column: str) -> DataFrame:
        """The table, less the ranges that hold none of ``keys``: the driver learns
        which of at most 512 ranges to open."""
        bounds = self.manifest["tables"][name]["bounds"]
        hit = keys.where(F.col(column).isNotNull()).select(range_of(F.col(column), bounds).alias("k")).distinct().collect()
        return self._rows(name, sorted(r["k"] for r in hit))

    @property
    def rulings(self) -> DataFrame:
        return self.table("rulings")

    @property
    def citations(self) -> DataFrame:
        return self.table("citations")

    @property
    def aliases(self) -> DataFrame:
        return self.table("aliases")

    @property
    def meta(self) -> dict[str, str]:
        return dict(self.manifest["meta"])

    def merge(self, rulings: DataFrame | None = None, citations: DataFrame | None = None, aliases: DataFrame | None = None, order: list[str] | None = None, meta: dict[str, str] | None = None, share: float | None = SHARE) -> GraphStore:
        """Upsert a batch: its rows, folded in ``order``, go to the logs of the ranges
        they belong to.  A range whose log, with the batch's rows as they are given,
        has reached ``share`` of its base is folded with them into a new base in the
        same commit; None leaves all logs.  ``meta`` overwrites
        the stored values of its keys.  Fails with :class:`CommitConflict` if another
        writer came first, and then changes nothing."""
        manifest = json.loads(json.dumps(self.manifest))
        manifest["meta"].update(meta or {})
        for name, given in (("rulings", rulings), ("citations", citations), ("citing", citations), ("aliases", aliases)):
            if given is None:
                continue
            batch, by = _ready(given, TABLES[name], order)
            ranges = manifest["tables"][name]["ranges"]
            batch, due = self._folded_at_once(name, batch, by, ranges, share)
            for k, (path, n) in due.items():
                ranges[k] = {"base": [path], "log": [], "base_rows": n, "log_rows": 0}
            if batch is None:
                continue
            for k, (path, n) in self._write(name, batch, by, self.version + 1).items():
                ranges[k]["log"].append(path)
                ranges[k]["log_rows"] += n
        if share is not None:
            self._compacted(manifest, share)
        return self._commit(manifest)

    def _folded_at_once(self, name: str, batch: DataFrame, by: list[str] | None, ranges: list[dict], share: float | None) -> tuple[DataFrame | None, dict[int, tuple[str, int]]]:
        """(what is left for the logs, {range: (folder, rows)} of new bases): ranges
        that ``batch`` makes due for compaction are written once, not as a log first."""
        if share is None:
            return batch, {}
        table = TABLES[name]
        at = range_of(F.col(table.key), self.manifest["tables"][name]["bounds"])
        new = {r["k"]: r["n"] for r in batch.groupBy(at.alias("k")).agg(F.count("*").alias("n")).collect()}
        due = sorted(k for k, n in new.items() if ranges[k]["log_rows"] + n >= share * ranges[k]["base_rows"])
        if not due:
            return (batch if new else None), {}
        some = batch if len(due) == len(new) else batch.where(at.isin(due))
        stored, order = self._writes(name, [ranges[k] for k in due]), ["seq"]
        some = some.withColumn("seq", F.lit(self.version + 1).cast("long"))
        if by:  # rows of one write come in the batch's own order
            order += by
            for c in by:
                stored = stored.withColumn(c, F.lit(None).cast(batch.schema[c].dataType))
        made = self._write(name, stored.unionByName(some), order)
        return (None if len(due) == len(new) else batch.where(~at.isin(due))), made

    def compact(self, share: float = 0.0) -> GraphStore:
        """Fold the logs that have reached ``share`` of their bases into new bases."""
        manifest = json.loads(json.dumps(self.manifest))
        self._compacted(manifest, share)
        return self._commit(manifest)

    def _compacted(self, manifest: dict, share: float) -> None:
        view = object.__new__(GraphStore)
        view.spark, view.folder, view.manifest, view.version = self.spark, self.folder, manifest, self.version
        for name, stored in manifest["tables"].items():
            due = [k for k, p in enumerate(stored["ranges"]) if p["log"] and p["log_rows"] >= share * p["base_rows"]]
            if not due:
                continue
            new = view._write(name, view._writes(name, [stored["ranges"][k] for k in due]), ["seq"])
            for k in due:
                path, n = new.get(k, (None, 0))
                stored["ranges"][k] = {"base": [path] if path else [], "log": [], "base_rows": n, "log_rows": 0}

    def files(self, name: str) -> dict[int, list[str]]:
        """The folders that make up each range of a table."""
        return {k: [*p["base"], *p["log"]] for k, p in enumerate(self.manifest["tables"][name]["ranges"])}

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the last ``keep`` commits names, and the commits before
        them.  Whoever reads an older commit, or writes meanwhile, is cut off."""
        names = [n for n in self._manifests.names() if n.isdigit()]
        kept = [json.loads(self._manifests.read(n)) for n in names[-max(keep, 1) :]]
        live = {p for m in kept for t in m["tables"].values() for r in t["ranges"] for p in (*r["base"], *r["log"])}
        gone = 0
        for name in TABLES:
            here = Folder(self.spark, f"{self.folder}/{name}")
            for write in here.names():
                inside = Folder(self.spark, f"{here.path}/{write}")
                for part in inside.names("range="):
                    if f"{name}/{write}/{part}" not in live:
                        inside.delete(part)
                        gone += 1
                if not inside.names("range="):
                    here.delete(write)
        for old in names[: -max(keep, 1)]:
            self._manifests.delete(old)
        return gone


def _ready(rows: DataFrame, table: _Table, order: list[str] | None) -> tuple[DataFrame, list[str] | None]:
    """The rows with the table's columns (nullable ones that are absent become null)
    and by what they are to be folded into one row for each key, if they are."""
    have = set(rows.columns)
    lost = [f.name for f in table.schema if not f.nullable and f.name not in have]
    if lost:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]
    if not order or not have.issuperset(order):
        return rows.select(*columns), None
    return rows.select(*columns, F.struct(*order).alias("_order")), ["_order"]
