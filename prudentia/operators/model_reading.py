"""Passages read by a pluggable model, under one budget for the whole cluster.

Every question (a passage and the ruling cited in it) has a digest, and digests
are the one order in which questions are put.  Waves of them are cut in that
order before anything is asked: the first is a small probe, each later one as
large as the money left pays for at the mean cost seen so far.  So the same
questions are put however the rows are partitioned, and the budget is one.

Answers are kept by digest, wave by wave.  A later run, or one after a crash, puts
only questions that have no answer yet.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prudentia.functions.spans import citations_in
from prudentia.functions.treatment import grounded
from prudentia.schema import is_placeholder
from prudentia.sources.shared import Folder

#: (quote, cited id) -> {"treatment", "confidence", "evidence", "cost"}; None for a
#: call that failed.  Any of them may be absent.
Model = Callable[[str, str], dict | None]
PROBE, GROWTH = 16, 8
_ANSWERS = "digest string, answered boolean, treatment string, confidence double, evidence string, cost double"


@dataclass
class Spent:
    """What a folder's answers have cost, and what a run left unread."""

    calls: int = 0
    failed: int = 0
    cost: float = 0.0
    limit: float = 0.0
    left: int = 0

    @property
    def per_call(self) -> float:
        return self.cost / self.calls if self.calls else 0.0

    @property
    def exhausted(self) -> bool:
        return self.cost >= self.limit

    def affords(self) -> int | None:
        """How many calls the money left pays for at the mean cost; None if calls
        have cost nothing so far."""
        if self.exhausted:
            return 0
        return None if not self.per_call else math.floor((self.limit - self.cost) / self.per_call + 1e-9)


def digest_of(quote: Column, cited: Column) -> Column:
    return F.sha2(F.concat_ws("\n", cited, quote), 256)


@F.pandas_udf(T.BooleanType())
def _names(quote: pd.Series, cited: pd.Series) -> pd.Series:
    return pd.Series([any(c == f"fallos:{v}:{p}" for *_, v, p in citations_in(q)) for q, c in zip(quote, cited, strict=True)], dtype=bool)


def questions(edges: DataFrame) -> DataFrame:
    """(digest, quote, cited_id): each different question that edges pose.  Passages
    that stand for an edge without one, and those that don't hold the citation
    they are filed under, pose none."""
    place = F.concat(F.lit("(?U)"), F.element_at(F.split("cited_id", ":"), 2), F.lit(r"\s*:\s*"), F.element_at(F.split("cited_id", ":"), 3))
    may = F.coalesce(F.rlike("quote", place) & ~is_placeholder(F.col("quote")), F.lit(False))  # what can't hold it never reaches Python
    return edges.where(may).select("quote", "cited_id").distinct().where(_names("quote", "cited_id")).withColumn("digest", digest_of(F.col("quote"), F.col("cited_id")))


def first_by_digest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of smallest ``digest``: whole blocks of digests by their counts,
    and of one block the first.  The driver holds a count for each of 65,536
    blocks at most."""
    block = F.substring("digest", 1, 4)
    counts = rows.groupBy(block.alias("block")).agg(F.count("*").alias("n")).orderBy("block").collect()
    taken = 0
    for c in counts:
        if taken + c["n"] > n:
            whole = rows.where(block < c["block"])
            return whole.unionByName(rows.where(block == c["block"]).orderBy("digest").limit(n - taken))
        taken += c["n"]
    return rows


class ModelReader:
    """Reads edges' passages by ``model``; answers stay in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, model: Model):
        self.spark, self.folder, self._model = spark, folder.rstrip("/"), model
        self._waves = Folder(spark, f"{self.folder}/waves")

    def _ledger(self) -> list[dict]:
        return [json.loads(self._waves.read(n)) for n in self._waves.names() if n.isdigit()]

    def answers(self) -> DataFrame:
        """All answers so far, of waves that ended."""
        paths = [f"{self.folder}/{w['path']}" for w in self._ledger()]
        return self.spark.read.schema(_ANSWERS).parquet(*paths) if paths else self.spark.createDataFrame([], _ANSWERS)

    def spent(self, limit: float = 0.0) -> Spent:
        ledger = self._ledger()
        return Spent(sum(w["calls"] for w in ledger), sum(w["failed"] for w in ledger), sum(w["cost"] for w in ledger), limit)

    def _ask(self, wave: DataFrame, tasks: int) -> None:
        model = self._model

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for digest, quote, cited in zip(batch["digest"], batch["quote"], batch["cited_id"], strict=True):
                    try:
                        said = model(quote, cited)
                    except Exception:  # noqa: BLE001  a failed call costs its own answer and no more
                        said = None
                    said, whole = said or {}, said is not None
                    rows.append((digest, whole, said.get("treatment"), said.get("confidence"), said.get("evidence"), float(said.get("cost") or 0.0)))
                yield pd.DataFrame(rows, columns=["digest", "answered", "treatment", "confidence", "evidence", "cost"]).astype({"confidence": float})

        seen, path = Observation(), f"answers/{uuid.uuid4().hex}"
        asked = wave.select("digest", "quote", "cited_id").repartition(tasks, "digest").mapInPandas(put, _ANSWERS)
        asked.observe(seen, F.count("*").alias("calls"), F.count_if(~F.col("answered")).alias("failed"), F.sum("cost").alias("cost")).write.parquet(f"{self.folder}/{path}")
        got = seen.get
        number = len(self._waves.names())
        self._waves.create(f"{number:06d}", json.dumps({"path": path, "calls": got["calls"], "failed": got["failed"], "cost": got["cost"] or 0.0}))

    def read(self, edges: DataFrame, limit: float, most: int | None = None, tasks: int | None = None) -> Spent:
        """Put the questions of ``edges`` until all have an answer, all answers of the
        folder together have cost ``limit``, or this run has put ``most``.

        Before each wave the mean cost of all calls so far says how many calls the
        money left pays for; a wave is at most ``GROWTH`` times all calls before
        it, so a mean taken from few calls decides over few.
        """
        tasks = tasks or self.spark.sparkContext.defaultParallelism
        every, put = questions(edges), 0
        while True:
            spent = self.spent(limit)
            left = every.join(self.answers().select("digest"), "digest", "left_anti").persist()
            try:
                spent.left = left.count()
                size = min([spent.left, max(PROBE, GROWTH * spent.calls) if spent.calls else PROBE, *([] if most is None else [most - put])])
                affords = spent.affords()
                size = size if affords is None else min(size, affords)
                if size <= 0:
                    return spent
                self._ask(first_by_digest(left, size), tasks)
                put += size
            finally:
                left.unpersist()

    def readings(self, edges: DataFrame) -> DataFrame:
        """(citing_id, cited_id, quote, treatment, confidence, method) of the edges
        that a grounded answer reads; ungrounded and failed ones leave an edge as
        it is."""
        said = self.answers().where("answered")
        digest = digest_of(F.col("quote"), F.col("cited_id"))
        keyed = edges.select("citing_id", "cited_id", "quote", digest.alias("digest"))
        read = keyed.join(said, "digest").withColumn("r", grounded(F.col("treatment"), F.col("confidence"), F.col("evidence"), F.col("quote")))
        return read.where("r IS NOT NULL").select("citing_id", "cited_id", "quote", "r.treatment", "r.confidence", "r.method")

    def report(self, edges: DataFrame) -> DataFrame:
        """One row: calls, failed ones, refused (answers whose evidence doesn't stand
        in the passage), cost and mean cost of a call."""
        text = questions(edges).select("digest", "quote")
        verdict = grounded(F.col("treatment"), F.col("confidence"), F.col("evidence"), F.col("quote"))
        told = self.answers().join(text, "digest").agg(
            F.count("*").alias("calls"), F.count_if(~F.col("answered")).alias("failed"), F.count_if(F.col("answered") & verdict.isNull()).alias("refused"), F.sum("cost").alias("cost")
        )
        return told.select("calls", "failed", "refused", F.round(F.coalesce("cost", F.lit(0.0)), 9).alias("cost"), F.round(F.try_divide("cost", "calls"), 9).alias("mean_cost"))
