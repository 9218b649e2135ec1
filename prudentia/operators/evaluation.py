"""How well the rules read passages whose treatment is known.

A reading that calls a living doctrine abandoned costs its reader an authority; a
departure that is missed costs coverage.  Only the first makes a rule set unfit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.functions.treatment import read_passages


class FalseRed(AssertionError):
    """Passages that depart from nothing were read as departures."""


def judged(passages: DataFrame, quote: str, position: Column) -> DataFrame:
    """Passages (with ``expected``) and how the rules read them: ``got``, ``rule``,
    ``scope`` and ``confidence``.  A null position has the whole passage read."""
    read = read_passages(passages, quote, position, "_r")
    return read.withColumns({"got": F.col("_r.treatment"), "rule": F.col("_r.rule"), "scope": F.col("_r.scope"), "confidence": F.col("_r.confidence")}).drop("_r")


def confusion(read: DataFrame, *by: str) -> DataFrame:
    """How many passages of each expected treatment were read as which."""
    return read.groupBy(*by, "expected", "got").agg(F.count("*").alias("n"))


def evaluation(matrix: DataFrame, *by: str) -> DataFrame:
    """From a confusion matrix, for each group or over all: passages, right ones,
    ``false_red`` (read as abandoned, and aren't), ``missed_red`` (abandoned, and not
    read so).  A passage without an expected treatment is never right, and is a
    false red if it is read as abandoned.  Without passages all counts are 0."""
    same, red = F.col("expected").eqNullSafe(F.col("got")), F.lit("abandoned")
    total = lambda rows: F.coalesce(F.sum(F.when(rows, F.col("n"))), F.lit(0))
    is_red, was_red = F.col("expected").eqNullSafe(red), F.col("got").eqNullSafe(red)
    return matrix.groupBy(*by).agg(total(F.lit(True)).alias("n"), total(same & F.col("expected").isNotNull()).alias("correct"), total(was_red & ~is_red).alias("false_red"), total(is_red & ~was_red).alias("missed_red"))


def gate(report: DataFrame) -> None:
    """Raise :class:`FalseRed` if the report (:func:`evaluation`) has any; missed
    departures pass."""
    wrong = report.agg(F.sum("false_red")).first()[0] or 0
    if wrong:
        raise FalseRed(f"{wrong} passages were read as departures and are none")
