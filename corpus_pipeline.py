"""A corpus pipeline: each stage takes what the one before has kept.

Quality rules drop documents, near-duplicate groups shrink to one document,
repeated passages go, sources are mixed to their weights, and texts become ids.

Stages take the columns of ``documents``; others are left out.  Empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.llm.mixing import mix, word_count
from prudentia.llm.near_dup import near_duplicates
from prudentia.llm.perplexity import judge
from prudentia.llm.pieces import encode_and_decode
from prudentia.llm.queries import SOURCE_WEIGHTS, piece_model
from prudentia.llm.storage import scratch, written
from prudentia.llm.suffix_dedup import remove_repeats
from prudentia.plans.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity bands.

    Null and empty texts fail.  Null languages are a language of their own.
    Repeated rows are judged alike and all stay or go.
    """
    ship_package(spark)
    return judge(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def once(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of those that agree in doc_id and text."""
    key = ["doc_id", F.xxhash64("text").alias("_text")]
    again = written(docs.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1"), "repeated-rows")
    if again.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_text"))
    again = again.select(F.col("doc_id").alias("_doc"), "_text")
    return docs.join(again, same, "left_anti").union(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate group.

    Of rows that agree in doc_id and text one stays, as the next stage would take
    the text of both.  Documents without a doc_id aren't judged and stay; those
    without words have no near-duplicates.
    """
    ship_package(spark)
    docs = once(docs)
    with scratch(spark):
        judged = near_duplicates(docs.select(COLUMNS), percent=80)
        gone = written(judged.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "gone", stays=True)
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once.  Null texts
    stay null; a text that is all repeated becomes empty."""
    ship_package(spark)
    return remove_repeats(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, as repeated rows.  Null sources
    are one source; null and empty texts have no size and come as often as their
    source is taken whole.  Rows that agree in doc_id and text count once."""
    ship_package(spark)
    docs = once(docs.select(COLUMNS))
    key = F.xxhash64("text")
    sized = written(docs.select("doc_id", "source", key.alias("_text"), word_count(F.col("text")).alias("size")), "sizes")
    mixed = mix(sized, "source", "size", "doc_id", SOURCE_WEIGHTS).where("repeats > 0").select(F.col("doc_id").alias("_doc"), "_text", "repeats")
    taken = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (key == F.col("_text")))  # texts move once
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its ids, the bytes that their spans cover and a digest of
    what they decode to.  Null and empty texts have begin and end ids only."""
    ship_package(spark)
    return encode_and_decode(docs.select(COLUMNS), piece_model())


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("repeated passages", passage_dedup),
    ("source mix", mix_sources),
    ("piece encoding", encode),
]

#: SQL can express neither the model of the first stage nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
