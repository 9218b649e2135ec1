"""Streaming ingest of source records: an append-only log, folded on read.

A stream of API records is parsed and appended, batch by batch, to the logs of
rulings, aliases and edges.  A write's order is its batch (``seq``) and its place
in the batch (``place``), and a batch that is delivered again replaces its own
partition; so reruns and late duplicates change nothing once the logs are folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prudentia.operators.upserts import aliases_of_records, checked_aliases, checked_citations, checked_rulings, edges_of_records, fold_aliases, fold_citations, fold_rulings, source_url, stub_rulings
from prudentia.schema import MAX_PAGE, RULINGS
from prudentia.sources.records import parse_records


def record_rulings(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The nodes that records state."""
    return records.select(
        "id",
        "volume",
        "page",
        F.when(F.col("caption") == "", F.col("id")).otherwise(F.col("caption")).alias("caption"),
        F.lit(None).cast("string").alias("short_name"),
        "decided_on",
        "decided_year",
        source_url(F.col("volume"), F.col("page")).alias("source_url"),
        F.lit("unavailable").alias("text_status"),
        F.lit(None).cast("double").alias("text_quality"),
        "csjn_doc_id",
        *keep,
    )


def _append(records: DataFrame, folder: str, number: int, last_page: int = MAX_PAGE) -> None:
    """Put what the records of a batch state, in place of what the same batch may
    have put before it was broken off."""
    stated = (
        ("rulings", checked_rulings(record_rulings(records, ("place",)), last_page)),
        ("aliases", checked_aliases(aliases_of_records(records, ("place",)))),
        ("citations", checked_citations(edges_of_records(records, ("place",)))),
    )
    for name, rows in stated:
        numbered = rows.withColumn("seq", F.lit(number).cast("long"))
        numbered.where("reason = 'accepted'").drop("reason").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        numbered.where("reason <> 'accepted'").write.mode("overwrite").parquet(f"{folder}/rejected/{name}/batch={number}")


def ingest(stream: DataFrame, value: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of JSON records (column ``value``) to the logs in
    ``folder``; rejected rows go to ``folder/rejected``.  Of a batch, records
    count in the order in which Spark reads its files and their lines."""

    def append(batch: DataFrame, number: int) -> None:
        placed = batch.select(value, F.array(F.monotonically_increasing_id()).alias("place"))
        records = parse_records(placed, value, ("place",)).persist()
        try:
            _append(records, folder, number)
        finally:
            records.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_pages(stream: DataFrame, folder: str, checkpoint: str, last_page: int = MAX_PAGE) -> StreamingQuery:
    """Append the records of a stored crawl's stream to the logs in ``folder``, in
    the crawl's order; then the state of its pages to ``folder/pages``, last, so
    that a page counts as read only when what it states is stored.  Records count
    up to page ``last_page`` of a volume."""

    def append(batch: DataFrame, number: int) -> None:
        whole = [F.col(c).cast("long") for c in ("run", "volume", "start", "position")]
        batch = batch.persist()
        try:
            placed = batch.where("record IS NOT NULL").select("record", F.array(*whole).alias("place"))
            records = parse_records(placed, "record", ("place",), last_page).persist()
            _append(records, folder, number, last_page)
            records.unpersist()
            pages = batch.select("volume", "total", "start", "state").distinct()
            pages.write.mode("overwrite").parquet(f"{folder}/pages/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rulings, citations) as the logs leave them, with a node for every
    ruling that edges name."""
    order = ["seq", "place"]
    edges = fold_citations(spark.read.parquet(f"{folder}/citations").drop("batch"), order)
    nodes = fold_rulings(spark.read.parquet(f"{folder}/rulings").drop("batch"), order).select(*RULINGS.fieldNames())
    return nodes.unionByName(stub_rulings(edges, nodes)), edges


def folded_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """The forms under which the records' rulings are known."""
    return fold_aliases(spark.read.parquet(f"{folder}/aliases").drop("batch"), ["seq", "place"])
