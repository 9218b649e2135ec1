"""A citation graph derived from the star-schema test tables.

Parts become rulings and line items citations, by formulas that SQL repeats
word for word; so any query over the graph can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to some tasks for each core: what is made of a row may be far more
    work than the file it stands in, which is one task's by its size."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def ruling_id(key):
    """The id of the ruling made from a part key."""
    return F.concat(F.lit("fallos:"), 300 + F.pmod(key, F.lit(50)), F.lit(":"), 1 + F.floor(key / F.lit(50.0)))


def rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        ruling_id(key).alias("id"),
        (300 + key % 50).cast("int").alias("volume"),
        (1 + F.floor(key / F.lit(50.0))).cast("int").alias("page"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("caption"),
        F.when(key % 23 == 0, 0).otherwise(1980 + (key * 7) % 40).cast("int").alias("decided_year"),
        F.element_at(F.array(*map(F.lit, ("extracted", "ocr", "garbled", "unavailable"))), (F.col("p_size") % 4 + 1).cast("int")).alias("text_status"),
    )


_TREATMENTS = ("applied", "followed", "mentioned", "distinguished", "limited", "criticized", "abandoned")
_OPINIONS = {"RO": "majority", "RF": "concurrence", "AF": "dissent", "AO": "partial_dissent", "NO": "dictamen", "NF": "unknown"}


def citation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a citation, repeats included, with ``seq`` columns
    that order them."""
    n = table(spark, sf_dir, "part").count()
    opinion = F.lit(None).cast("string")
    for code, name in _OPINIONS.items():
        opinion = F.when(F.concat("l_returnflag", "l_linestatus") == code, name).otherwise(opinion)
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            ruling_id((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % F.lit(n)).alias("citing_id"),
            ruling_id(F.col("l_partkey")).alias("cited_id"),
            F.element_at(F.array(*map(F.lit, _TREATMENTS)), F.col("l_linenumber")).alias("treatment"),
            opinion.alias("opinion"),
            (F.round(F.col("l_discount") * 100).cast("int") / F.lit(10.0)).alias("confidence"),
            F.concat(F.lit("passage "), "l_orderkey", F.lit("/"), "l_linenumber").alias("quote"),
            F.element_at(F.array(*map(F.lit, ("rule", "llm", "manual"))), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("method"),
            F.col("l_suppkey").alias("sumario_id"),
            F.col("l_shipdate").alias("seq_date"),
            F.col("l_extendedprice").alias("seq_price"),
        )
        .where("citing_id <> cited_id")
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation_log(spark, sf_dir).drop("seq_date", "seq_price")


#: The same graph in SQL, as the head of a statement.
GRAPH_SQL = """
WITH rulings AS (
  SELECT 'fallos:' || (300 + p_partkey % 50) || ':' || (1 + CAST(floor(p_partkey / 50.0) AS INT)) AS id,
         CAST(300 + p_partkey % 50 AS INT) AS volume,
         CAST(1 + floor(p_partkey / 50.0) AS INT) AS page,
         p_name || ' ' || p_type || ' ' || p_brand AS caption,
         CAST(CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE 1980 + (p_partkey * 7) % 40 END AS INT) AS decided_year,
         (['extracted', 'ocr', 'garbled', 'unavailable'])[CAST(p_size % 4 + 1 AS INT)] AS text_status
  FROM part),
log AS (
  SELECT *, 'fallos:' || (300 + ck % 50) || ':' || (1 + CAST(floor(ck / 50.0) AS INT)) AS citing_id,
         'fallos:' || (300 + l_partkey % 50) || ':' || (1 + CAST(floor(l_partkey / 50.0) AS INT)) AS cited_id
  FROM (SELECT *, (l_orderkey * 13 + l_linenumber) % (SELECT count(*) FROM part) AS ck FROM lineitem)),
citation_log AS (
  SELECT citing_id, cited_id,
         (['applied', 'followed', 'mentioned', 'distinguished', 'limited', 'criticized', 'abandoned'])[l_linenumber] AS treatment,
         CASE l_returnflag || l_linestatus WHEN 'RO' THEN 'majority' WHEN 'RF' THEN 'concurrence' WHEN 'AF' THEN 'dissent'
              WHEN 'AO' THEN 'partial_dissent' WHEN 'NO' THEN 'dictamen' WHEN 'NF' THEN 'unknown' END AS opinion,
         CAST(round(l_discount * 100) AS INT) / CAST(10 AS DOUBLE) AS confidence,
         'passage ' || l_orderkey || '/' || l_linenumber AS quote,
         (['rule', 'llm', 'manual'])[CAST(l_suppkey % 3 + 1 AS INT)] AS method,
         l_suppkey AS sumario_id, l_shipdate AS seq_date, l_extendedprice AS seq_price
  FROM log WHERE citing_id <> cited_id),
citations AS (SELECT * EXCLUDE (seq_date, seq_price) FROM citation_log)
"""
