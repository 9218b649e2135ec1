"""Queries of the batch work over a graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.operators import batches
from prudentia.operators.model_reading import ModelReader
from prudentia.plans import text_queries
from prudentia.plans.derived import GRAPH_SQL, citations, rulings, table
from prudentia.schema import CITATIONS
from prudentia.sources.shared import new_dir
from prudentia.sources.store import GraphStore


def pending_rulings(spark, sf_dir):
    """Citing rulings that are still to be read."""
    asked = citations(spark, sf_dir).select(F.col("citing_id").alias("id"))
    return batches.pending(asked, rulings(spark, sf_dir).where("text_status <> 'unavailable'"))


def crawled_range(spark, sf_dir):
    """For each state of texts the volumes in which it occurs, as text, and
    their range."""
    done = rulings(spark, sf_dir).groupBy("text_status").agg(F.array_join(F.array_sort(F.collect_set("volume")).cast("array<string>"), ",").alias("done"))  # at most MAX_VOLUME numbers
    found = done.withColumn("r", batches.crawled_range(F.col("done")))
    return found.select("text_status", batches.status_label(F.col("text_status")).alias("label"), "done", "r.low", "r.high")


def _edges_with_placeholders(spark, sf_dir):
    """The citations, a third of them with a placeholder for a quote."""
    words = F.when(F.col("sumario_id") % 2 == 0, "REFERENCIA publicada por la csjn, sumario ").otherwise("Referencia publicada por la CSJN, sumario ")
    quote = F.when(F.col("sumario_id") % 3 == 0, F.concat(words, F.col("sumario_id").cast("string"), F.lit(", "), F.col("quote"))).otherwise(F.col("quote"))
    return citations(spark, sf_dir).withColumn("quote", quote)


def reclassify_selection(spark, sf_dir):
    return batches.reclassify_selection(_edges_with_placeholders(spark, sf_dir), 50)


def ingest_documents(spark, sf_dir):
    """A batch over all documents, each with a citation behind its text, that
    goes on after those in German: the report."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    cited = F.concat(F.lit(" Fallos: "), (300 + key % 50).cast("string"), F.lit(":"), (1 + key % 999).cast("string"), F.lit("."))
    report, _ = batches.ingest(docs.select(key.cast("string").alias("id"), F.concat("text", cited).alias("text")), docs.where("lang = 'de'").select(key.cast("string").alias("id")))
    return report.select("id", "text_status", F.round("text_quality", 6).alias("text_quality"), "n_edges", "error")


_ingested: dict[tuple[str, str], str] = {}


def _ingested_graph(spark, sf_dir) -> GraphStore:
    """A store with the rulings of the German documents, read before, and a
    description of every fifth; all documents ingested into it, once a session."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _ingested:
        docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
        ident = F.format_string("fallos:%d:%d", 1 + key % 250, 1 + F.floor(key / F.lit(250.0)))
        cites = F.format_string(" Fallos: %d:%d, %d:%d.", 1 + (key * 7) % 300, 1 + key % 60, 1 + key % 250, 1 + F.floor(key / F.lit(250.0)))
        made = docs.select(ident.alias("id"), F.concat("text", cites).alias("text"), "lang", "doc_id")
        stored = made.where("lang = 'de' OR doc_id % 5 = 0").select(
            "id", F.split("id", ":")[1].cast("int").alias("volume"), F.split("id", ":")[2].cast("int").alias("page"),
            F.concat(F.lit("caso "), "id").alias("caption"), (1900 + key % 100).cast("int").alias("decided_year"), F.lit("u").alias("source_url"),
            F.when(F.col("lang") == "de", "ocr").otherwise("unavailable").alias("text_status"),
        )
        folder = new_dir(spark, "ingesting")
        store = GraphStore.create(spark, folder, stored, spark.createDataFrame([], CITATIONS), rows=5_000)
        batches.ingest_into(store, made, made.where("doc_id % 3 = 0").select("id", F.lit("Tres").alias("short_name")))
        _ingested[known] = folder
    return GraphStore(spark, _ingested[known])


def ingest_into_graph(spark, sf_dir):
    """The nodes after all documents were ingested: read, described and stubs."""
    nodes = _ingested_graph(spark, sf_dir).rulings
    return nodes.select("id", "volume", "page", "caption", "short_name", "decided_year", "text_status", F.round("text_quality", 6).alias("text_quality"))


def ingest_edges_of_graph(spark, sf_dir):
    """The edges that the ingestion wrote, by both directions of the adjacency."""
    store = _ingested_graph(spark, sf_dir)
    one = lambda name: store.table(name).select(F.lit(name).alias("side"), "citing_id", "cited_id", "treatment", "opinion", "method")
    return one("citations").union(one("citing"))


#: What the made model's calls cost, and the budget of a run.
CALL, LIMIT = 0.01, 4.0


def made_model(quote: str, cited: str) -> dict:
    """Stands for a model: sure of odd pages, and inventing its evidence for every
    third."""
    page = int(cited.rsplit(":", 1)[1])
    evidence = "no dice esto" if page % 3 == 0 else quote[4:24]
    return {"treatment": "followed", "confidence": 0.9 if page % 2 else 0.5, "evidence": evidence, "cost": CALL}


def _questions(spark, sf_dir):
    p = text_queries.passages(spark, sf_dir)
    return p.select(F.concat(F.lit("k"), F.col("key").cast("string")).alias("citing_id"), F.regexp_replace(F.lower("cited"), " ", "").alias("cited_id"), "quote")


def _read(spark, sf_dir) -> tuple[ModelReader, DataFrame]:
    edges = _questions(spark, sf_dir)
    reader = ModelReader(spark, new_dir(spark, "model"), made_model)
    reader.read(edges, LIMIT)
    return reader, edges


def model_readings(spark, sf_dir):
    """What a model reads of all parts' passages for a budget of 400 calls."""
    reader, edges = _read(spark, sf_dir)
    return reader.readings(edges)


def model_report(spark, sf_dir):
    reader, edges = _read(spark, sf_dir)
    return reader.report(edges)


_WITH_CITATION = "SELECT * REPLACE (text || ' Fallos: ' || (300 + doc_id % 50) || ':' || (1 + doc_id % 999) || '.' AS text) FROM documents WHERE lang IS DISTINCT FROM 'de'"
_JUDGED = text_queries.SQL["text_quality"].replace("FROM documents", f"FROM ({_WITH_CITATION})")

_RULED = "'fallos:' || (1 + doc_id % 250) || ':' || (1 + doc_id // 250)"
_MADE = f"""WITH made AS (SELECT *, {_RULED} AS id, 'fallos:' || (1 + doc_id * 7 % 300) || ':' || (1 + doc_id % 60) AS other FROM documents),
whole AS (SELECT made.* REPLACE (text || ' Fallos: ' || replace(other, 'fallos:', '') || ', ' || replace(id, 'fallos:', '') || '.' AS text) FROM made),
judged AS ({text_queries.SQL['text_quality'].replace('FROM documents', 'FROM whole')}),
read AS (SELECT made.*, status, quality FROM made JOIN judged USING (doc_id) WHERE lang IS DISTINCT FROM 'de'),
edges AS (SELECT DISTINCT id AS citing_id, other AS cited_id FROM read WHERE status = 'extracted' AND other <> id)
"""

_ASKED = f"""WITH p AS (SELECT *, 'Fallos: ' || (300 + p_partkey % 50) || ':' || (1 + p_partkey % 9000) AS cite FROM part),
q AS (SELECT p_partkey, replace(lower(cite), ' ', '') AS cited_id, 1 + p_partkey % 9000 AS page,
             replace(list_value({', '.join("'" + t[0].replace("'", "''") + "'" for t in text_queries._TEMPLATES)})[CAST(p_partkey % {len(text_queries._TEMPLATES)} + 1 AS INT)], '%s', cite) AS quote FROM p),
asked AS (SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY sha256(cited_id || chr(10) || quote)) AS place FROM q) WHERE place <= {round(LIMIT / CALL)})
"""

SQL = {
    "model_readings": _ASKED + "SELECT 'k' || p_partkey AS citing_id, cited_id, quote, 'followed' AS treatment, CASE WHEN page % 2 = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, 'llm' AS method FROM asked WHERE page % 3 <> 0",
    "model_report": _ASKED + f"SELECT n AS calls, 0::BIGINT AS failed, refused, round({CALL} * n, 9)::DOUBLE AS cost, {CALL}::DOUBLE AS mean_cost FROM (SELECT count(DISTINCT (cited_id, quote)) AS n, count(DISTINCT (cited_id, quote)) FILTER (page % 3 = 0) AS refused FROM asked)",
    "pending_rulings": GRAPH_SQL + "SELECT DISTINCT citing_id AS id FROM citations WHERE citing_id NOT IN (SELECT id FROM rulings WHERE text_status <> 'unavailable')",
    "crawled_range": GRAPH_SQL
    + f"""SELECT text_status, CASE text_status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in batches.STATUS_LABELS.items())} END AS label,
       array_to_string(list_sort(list(DISTINCT volume)), ',') AS done, min(volume) AS low, max(volume) AS high
FROM rulings GROUP BY 1""",
    "reclassify_selection": GRAPH_SQL
    + """, top AS (SELECT cited_id FROM citations GROUP BY 1 ORDER BY count(DISTINCT citing_id) DESC, cited_id LIMIT 50)
SELECT citing_id, cited_id, quote FROM citations WHERE cited_id IN (SELECT cited_id FROM top) AND confidence <= 0.25 AND sumario_id % 3 <> 0""",
    "ingest_into_graph": _MADE
    + """, nodes AS (
  SELECT id, CASE WHEN doc_id % 5 = 0 THEN 'caso ' || id ELSE replace(id, 'fallos:', 'Fallos: ') END AS caption, CASE WHEN doc_id % 3 = 0 THEN 'Tres' END AS short_name,
         CASE WHEN doc_id % 5 = 0 THEN 1900 + doc_id % 100 ELSE 0 END AS decided_year, status AS text_status, quality AS text_quality FROM read
  UNION ALL SELECT id, 'caso ' || id, NULL, 1900 + doc_id % 100, 'ocr', NULL FROM made WHERE lang = 'de'
  UNION ALL SELECT DISTINCT cited_id, replace(cited_id, 'fallos:', 'Fallos: '), NULL, 0, 'unavailable', NULL FROM edges WHERE cited_id NOT IN (SELECT id FROM made))
SELECT id, CAST(split_part(id, ':', 2) AS INT) AS volume, CAST(split_part(id, ':', 3) AS INT) AS page, caption, short_name, CAST(decided_year AS INT) AS decided_year, text_status, text_quality FROM nodes""",
    "ingest_edges_of_graph": _MADE + "SELECT side, citing_id, cited_id, 'mentioned' AS treatment, 'majority' AS opinion, 'rule' AS method FROM edges, (VALUES ('citations'), ('citing')) AS s(side)",
    "ingest_documents": f"""SELECT CAST(doc_id AS VARCHAR) AS id, status AS text_status, quality AS text_quality, CASE status WHEN 'extracted' THEN 1 ELSE 0 END AS n_edges,
       CASE status WHEN 'unavailable' THEN 'no text' WHEN 'garbled' THEN 'text below the quality floor' END AS error FROM ({_JUDGED})""",
}
QUERIES = {name: globals()[name] for name in SQL}
