"""Listings: who cites, who is cited, the most cited, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.schema import DEFAULT_LIMIT, MAX_LIMIT

#: The columns of a ruling that listings show.
SHOWN = ["id", "volume", "page", "caption", "decided_year", "text_status"]


def clamp(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(max(DEFAULT_LIMIT if limit is None else limit, 1), MAX_LIMIT), max(offset or 0, 0)


def _edges(citations: DataFrame, rulings: DataFrame, fixed: str, other: str, ident: str, treatment: str | None) -> DataFrame:
    edges = citations.where(F.col(fixed) == ident)
    if treatment is not None:
        edges = edges.where(F.col("treatment") == treatment)
    return rulings.select(SHOWN).join(edges.select(F.col(other).alias("id")).distinct(), "id", "left_semi")


def citing_page(citations: DataFrame, rulings: DataFrame, cited: str, treatment: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rulings that cite ``cited``, latest first."""
    limit, offset = clamp(limit, offset)
    found = _edges(citations, rulings, "cited_id", "citing_id", cited, treatment)
    return found.orderBy(F.desc("decided_year"), F.desc("volume"), F.desc("page")).offset(offset).limit(limit)


def cited_page(citations: DataFrame, rulings: DataFrame, citing: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rulings that ``citing`` cites, oldest first."""
    limit, offset = clamp(limit, offset)
    found = _edges(citations, rulings, "citing_id", "cited_id", citing, None)
    return found.orderBy("decided_year", "volume", "page").offset(offset).limit(limit)


def citing_totals(citations: DataFrame) -> DataFrame:
    """Distinct citing rulings of each cited one."""
    return citations.groupBy("cited_id").agg(F.countDistinct("citing_id").alias("total"))


def top_cited(citations: DataFrame, n: int) -> DataFrame:
    return citing_totals(citations).orderBy(F.desc("total"), "cited_id").limit(n)


def citers_of_top(citations: DataFrame, n: int) -> DataFrame:
    """Distinct rulings that cite one of the ``n`` most cited."""
    top = F.broadcast(top_cited(citations, n).select("cited_id"))  # n rows
    return citations.join(top, "cited_id", "left_semi").select("citing_id").distinct()


def status_counts(rulings: DataFrame) -> DataFrame:
    return rulings.groupBy("text_status").agg(F.count("*").alias("n"))


def whole_graph_counts(citations: DataFrame) -> DataFrame:
    return citations.groupBy("treatment").agg(F.count("*").alias("n"))


def dotted(number: str) -> Column:
    """5325 as 5.325."""
    return F.translate(F.format_number(number, 0), ",", ".")


def provenance(citations: DataFrame, rulings: DataFrame, low: int, high: int) -> DataFrame:
    """What the graph rests on, in one pass over each table; no row without
    edges."""
    edges = citations.agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("treatment") != "mentioned").alias("stance"),
        F.count_if(F.col("opinion") != "unknown").alias("attributed"),
        F.count_if(F.col("opinion") == "majority").alias("majority"),
    ).where("edges > 0")
    nodes = rulings.agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("text_status") == "extracted").alias("extracted"),
        F.count_if(F.col("text_status") == "ocr").alias("ocr"),
        F.count_if(F.col("volume").between(low, high)).alias("inside"),
        F.count_if(~F.col("volume").between(low, high)).alias("stubs"),
    )
    share = lambda c: F.bround(100 * F.col(c) / F.col("edges"), 1)
    joined = edges.join(nodes)  # one row each
    return joined.withColumn("stance_percent", share("stance")).withColumn("attributed_percent", share("attributed")).withColumn("edges_text", dotted("edges"))
