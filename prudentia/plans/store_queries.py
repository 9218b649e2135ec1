"""Queries over a stored graph, with their SQL: the graph of the test tables, its
first years stored, the later ones merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prudentia.operators import listing, signals, trace
from prudentia.plans import graph_queries
from prudentia.plans.derived import GRAPH_SQL, citation_log, rulings
from prudentia.plans.graph_queries import ASKED
from prudentia.sources.shared import new_dir
from prudentia.sources.store import GraphStore

_stores: dict[tuple[str, str], str] = {}
ORDER = ["seq_date", "seq_price", "sumario_id"]
#: Rows a range is made for: small, so that the test tables have several.
ROWS = 20_000


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulings(spark, sf_dir).withColumn("source_url", F.lit("u"))


def stored(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The graph, stored once a session: citations up to 1994, then two merges, of
    which small ones stay in the log; captions of one volume are written again."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _stores:
        log, described, folder = citation_log(spark, sf_dir), _described(spark, sf_dir), new_dir(spark, "graph")
        store = GraphStore.create(spark, folder, described.withColumn("caption", F.upper("caption")), log.where("seq_date < DATE'1995-01-01'"), order=ORDER, rows=ROWS)
        store = store.merge(citations=log.where("seq_date >= DATE'1995-01-01' AND seq_date < DATE'1998-01-01'"), order=ORDER)
        store.merge(rulings=described, citations=log.where("seq_date >= DATE'1998-01-01'"), order=ORDER, meta={"source": "test tables"}, share=0.5)
        _stores[known] = folder
    return GraphStore(spark, _stores[known])


def stored_citations(spark, sf_dir):
    """All edges, the log folded in."""
    return stored(spark, sf_dir).citations


def stored_counts(spark, sf_dir):
    """Both directions of the adjacency hold the same edges."""
    store = stored(spark, sf_dir)
    one = lambda name, key: store.table(name).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "id", "n")
    return one("citations", "cited_id").union(one("citing", "citing_id"))


def stored_point_lookup(spark, sf_dir):
    return stored(spark, sf_dir).lookup("rulings", ASKED).select("id", "volume", "page", "caption", "decided_year", "text_status")


def stored_citing_page(spark, sf_dir):
    store = stored(spark, sf_dir)
    edges = store.lookup("citations", ASKED)
    return listing.citing_page(edges, store.matching("rulings", edges, "citing_id"), ASKED)


def stored_cited_page(spark, sf_dir):
    store = stored(spark, sf_dir)
    edges = store.lookup("citing", ASKED)
    return listing.cited_page(edges, store.matching("rulings", edges, "cited_id"), ASKED, 2, 5)


def stored_signal(spark, sf_dir):
    """The signal of one ruling, from its own range and its neighbours'."""
    store = stored(spark, sf_dir)
    edges = store.lookup("citations", ASKED)
    asked = store.spark.range(1).select(F.lit(ASKED).alias("citing_id"))
    nodes = store.matching("rulings", edges.select("citing_id").union(asked), "citing_id")
    return signals.signals(nodes, edges).where(F.col("id") == ASKED).select(graph_queries._REPORT)


def stored_trace(spark, sf_dir):
    store = stored(spark, sf_dir)
    return trace.trace_steps(store.citations.where("opinion = 'majority'"), store.rulings, ASKED, 3)


SQL = {
    "stored_citations": graph_queries.SQL["upsert_citations"],
    "stored_counts": GRAPH_SQL + "SELECT 'citations' AS side, cited_id AS id, count(DISTINCT (citing_id, quote)) AS n FROM citations GROUP BY ALL UNION ALL SELECT 'citing', citing_id, count(DISTINCT (cited_id, quote)) FROM citations GROUP BY ALL",
    "stored_point_lookup": graph_queries.SQL["point_lookup"],
    "stored_citing_page": graph_queries.SQL["citing_page"],
    "stored_cited_page": graph_queries.SQL["cited_page"],
    "stored_signal": graph_queries.SQL["signal_status"] + f" WHERE id = '{ASKED}'",
    "stored_trace": graph_queries.SQL["trace_steps"],
}
QUERIES = {name: globals()[name] for name in SQL}
