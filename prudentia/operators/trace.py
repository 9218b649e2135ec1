"""Tracing a doctrine forward in time: a bounded breadth-first search."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.operators.signals import signals
from prudentia.schema import MAX_DEPTH, MAX_STEPS
from prudentia.sources.shared import new_dir

MOVING = ("applied", "followed", "distinguished", "limited", "criticized", "abandoned")


def moving(citations: DataFrame, rulings: DataFrame) -> DataFrame:
    """Edges that say something, of citing rulings that exist."""
    known = rulings.select(F.col("id").alias("citing_id"), F.col("decided_year").alias("year"))
    return citations.where(F.col("treatment").isin(*MOVING)).join(known, "citing_id")


def reached(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(id, depth): rulings within ``depth`` steps, each at its least depth.

    One join a level; the levels are kept in storage so that no level is
    computed again for the next.
    """
    spark = edges.sparkSession
    pairs = edges.select("cited_id", "citing_id").distinct().persist(StorageLevel.DISK_ONLY)
    seen = spark.createDataFrame([(start, 0)], "id string, depth int")
    frontier = seen
    for level in range(1, min(max(depth, 1), MAX_DEPTH) + 1):
        following = pairs.join(frontier.select(F.col("id").alias("cited_id")), "cited_id").select(F.col("citing_id").alias("id")).distinct()
        frontier = following.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level)).persist(StorageLevel.DISK_ONLY)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def trace_steps(citations: DataFrame, rulings: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """Every moving edge out of a ruling reached before the last level."""
    depth = min(max(depth, 1), MAX_DEPTH)
    edges = moving(citations, rulings)
    expanded = reached(edges, start, depth).where(F.col("depth") < depth)
    return edges.join(expanded.withColumnRenamed("id", "cited_id"), "cited_id").select("depth", F.col("cited_id").alias("from_id"), F.col("citing_id").alias("to_id"), "year", "treatment", "opinion", "confidence", "quote")


def chain(steps: DataFrame, most: int = MAX_STEPS) -> DataFrame:
    """The first ``most`` steps in order of year and depth."""
    return steps.orderBy("year", "depth", "from_id", "to_id", "treatment", "quote").limit(most)


@contextmanager
def _by_part_of_the_key(spark: SparkSession):
    """Joins on (start, id) of tables that are both dealt by id need no exchange."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class _Dealt:
    """Tables in shared storage that are bucketed by one column, all alike."""

    def __init__(self, spark: SparkSession):
        self._spark, self._names = spark, []
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(self, rows: DataFrame, key: str) -> DataFrame:
        name = f"prudentia_{uuid.uuid4().hex}"
        self._names.append(name)
        writer = rows.write.format("parquet").bucketBy(self.parts, key).sortBy(key)
        writer.option("path", new_dir(self._spark, "dealt")).saveAsTable(name)
        return self._spark.table(name)

    def forget(self) -> None:
        for name in self._names:
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay in the application's folder


def next_level(pairs: DataFrame, frontier: DataFrame, seen: list[DataFrame], parts: int) -> DataFrame:
    """(start, id): what the frontier leads to and no earlier level has.  Only what
    the step finds is shuffled: edges, frontier and levels lie dealt by the ids
    that they are joined on."""
    step = pairs.join(frontier.withColumnRenamed("id", "cited_id"), "cited_id").select("start", F.col("citing_id").alias("id"))
    found = step.repartition(parts, "id").dropDuplicates(["start", "id"])
    for level in seen:
        found = found.join(level.select("start", "id"), ["start", "id"], "left_anti")
    return found


def reached_from(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, depth): rulings within ``depth`` steps of each of ``starts`` (column
    ``id``), each at its least depth, for all starts at once."""
    spark = edges.sparkSession
    dealt = _Dealt(spark)
    with _by_part_of_the_key(spark):
        pairs = dealt.put(edges.select("cited_id", "citing_id").distinct().repartition(dealt.parts, "cited_id"), "cited_id")
        begun = starts.where("id IS NOT NULL").select(F.col("id").alias("start"), "id").distinct()
        seen = [dealt.put(begun.repartition(dealt.parts, "id"), "id")]
        for _ in range(min(max(depth, 1), MAX_DEPTH)):
            found = dealt.put(next_level(pairs, seen[-1], seen, dealt.parts), "id")
            if found.isEmpty():
                break
            seen.append(found)
        out = seen[0].withColumn("depth", F.lit(0))
        for level, rows in enumerate(seen[1:], 1):
            out = out.unionByName(rows.withColumn("depth", F.lit(level)))
        folder = new_dir(spark, "reached")
        out.write.parquet(folder)
    dealt.forget()
    return spark.read.schema("start string, id string, depth int").parquet(folder)


def traces(citations: DataFrame, rulings: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, depth, from_id, to_id, year, treatment, opinion, confidence, quote): the
    steps of :func:`trace_steps` for all starts at once."""
    depth = min(max(depth, 1), MAX_DEPTH)
    edges = moving(citations, rulings)
    expanded = reached_from(edges, starts, depth).where(F.col("depth") < depth)
    return edges.join(expanded.withColumnRenamed("id", "cited_id"), "cited_id").select("start", "depth", F.col("cited_id").alias("from_id"), F.col("citing_id").alias("to_id"), "year", "treatment", "opinion", "confidence", "quote")


def reached_signals(citations: DataFrame, rulings: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, id, depth, signal, confidence) of every ruling that the traces reach:
    one aggregate over the edges to any of them."""
    found = reached_from(moving(citations, rulings), starts, depth)
    ids = found.select("id").distinct()
    edges = citations.join(ids.withColumnRenamed("id", "cited_id"), "cited_id", "left_semi")
    lights = signals(rulings, edges).select("id", "signal", "confidence")
    return found.join(lights, "id", "left").select("start", "id", "depth", "signal", "confidence")
