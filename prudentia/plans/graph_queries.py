"""Queries over the derived citation graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudentia.operators import listing, signals, trace, upserts
from prudentia.plans.derived import GRAPH_SQL, citation_log, citations, ruling_id, rulings, table
from prudentia.schema import is_placeholder

#: The ruling that the single-ruling queries ask about.
ASKED = "fallos:307:1"

_REPORT = ["id", "signal", "confidence", "restored", "is_uniform", "total_citing", "n_records", "n_binding", "n_negative", "n_caution", "n_positive"]


def signal_status(spark, sf_dir):
    return signals.signals(rulings(spark, sf_dir), citations(spark, sf_dir)).select(_REPORT)


def signal_caveats(spark, sf_dir):
    report = signals.signals(rulings(spark, sf_dir), citations(spark, sf_dir))
    return signals.caveats(report).select("id", F.array_join("caveats", " | ").alias("caveats"))


def signal_evidence(spark, sf_dir):
    return signals.evidence(rulings(spark, sf_dir), citations(spark, sf_dir)).select("cited_id", "rank", "citing_id", "treatment", "opinion", "confidence", "year", "quote")


def treatment_counts(spark, sf_dir):
    return signals.treatment_counts(citations(spark, sf_dir))


def treatment_pivot(spark, sf_dir):
    return signals.treatment_pivot(citations(spark, sf_dir))


def nonbinding_by_opinion(spark, sf_dir):
    return signals.nonbinding_by_opinion(citations(spark, sf_dir))


def citing_page(spark, sf_dir):
    return listing.citing_page(citations(spark, sf_dir), rulings(spark, sf_dir), ASKED)


def citing_page_filtered(spark, sf_dir):
    return listing.citing_page(citations(spark, sf_dir), rulings(spark, sf_dir), ASKED, "followed", 1, 50)


def cited_page(spark, sf_dir):
    return listing.cited_page(citations(spark, sf_dir), rulings(spark, sf_dir), ASKED, 2, 5)


def citing_totals(spark, sf_dir):
    return listing.citing_totals(citations(spark, sf_dir))


def top_cited(spark, sf_dir):
    return listing.top_cited(citations(spark, sf_dir), 15)


def citers_of_top(spark, sf_dir):
    return listing.citers_of_top(citations(spark, sf_dir), 15)


def status_counts(spark, sf_dir):
    return listing.status_counts(rulings(spark, sf_dir))


def whole_graph_counts(spark, sf_dir):
    return listing.whole_graph_counts(citations(spark, sf_dir))


def provenance(spark, sf_dir):
    return listing.provenance(citations(spark, sf_dir), rulings(spark, sf_dir), 310, 329)


def point_lookup(spark, sf_dir):
    return rulings(spark, sf_dir).where(F.col("id") == ASKED)


def volume_range(spark, sf_dir):
    return rulings(spark, sf_dir).where(~F.col("volume").between(310, 329)).select("id", "volume", "decided_year")


def already_read(spark, sf_dir):
    return rulings(spark, sf_dir).where("text_status <> 'unavailable'").select("id", "text_status")


def unclassified_edges(spark, sf_dir):
    return citations(spark, sf_dir).where("method <> 'manual' AND confidence <= 0.25").where(~is_placeholder(F.col("quote"))).select("citing_id", "cited_id", "quote", "confidence")


def trace_steps(spark, sf_dir):
    binding_only = citations(spark, sf_dir).where("opinion = 'majority'")
    return trace.trace_steps(binding_only, rulings(spark, sf_dir), ASKED, 3)


def trace_chain(spark, sf_dir):
    return trace.chain(trace.trace_steps(citations(spark, sf_dir), rulings(spark, sf_dir), ASKED, 3))


def trace_signals(spark, sf_dir):
    edges, nodes = citations(spark, sf_dir), rulings(spark, sf_dir)
    seen = trace.reached(trace.moving(edges.where("opinion = 'majority'"), nodes), ASKED, 3)
    return seen.join(signals.signals(nodes, edges).select("id", "signal", "confidence"), "id", "left")


def upsert_citations(spark, sf_dir):
    return upserts.fold_citations(citation_log(spark, sf_dir), ["seq_date", "seq_price", "sumario_id"])


def _order_log(spark, sf_dir):
    """Orders as writes: each says something of one ruling."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        ruling_id(F.col("o_custkey")).alias("id"),
        (300 + F.col("o_custkey") % 50).cast("int").alias("volume"),
        (1 + F.floor(F.col("o_custkey") / F.lit(50.0))).cast("int").alias("page"),
        F.col("o_orderpriority").alias("caption"),
        F.year("o_orderdate").alias("decided_year"),
        F.lit("u").alias("source_url"),
        F.when(F.col("o_orderstatus") == "F", "extracted").otherwise("unavailable").alias("text_status"),
        F.when(key % 2 == 0, (key % 100) / F.lit(100.0)).alias("text_quality"),
        F.when(key % 3 == 0, F.concat(F.lit("N"), key.cast("string"))).alias("short_name"),
        F.when(key % 5 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("decided_on"),
        F.when(key % 7 == 0, key).alias("csjn_doc_id"),
        key.alias("seq"),
    )


def upsert_rulings(spark, sf_dir):
    return upserts.fold_rulings(_order_log(spark, sf_dir), ["seq"])


def upsert_aliases(spark, sf_dir):
    key = F.col("seq")
    log = _order_log(spark, sf_dir).select(
        F.when(key % 11 == 0, "  ").otherwise(F.concat(F.lit("ALIAS "), (key % 97).cast("string"))).alias("raw"),
        F.col("id").alias("ruling_id"),
        F.when(key % 2 == 0, "caption").otherwise("short_name").alias("form"),
        F.when(key % 3 == 0, "csjn").otherwise("manual").alias("source"),
        "seq",
    )
    return upserts.fold_aliases(log, ["seq"])


def stub_nodes(spark, sf_dir):
    known = rulings(spark, sf_dir).where("volume < 340")
    return upserts.stub_rulings(citations(spark, sf_dir), known).select("id", "volume", "page", "caption", "decided_year", "text_status")


def constraint_reject(spark, sf_dir):
    log = citation_log(spark, sf_dir)
    broken = log.withColumn("confidence", F.col("confidence") + F.when(F.col("sumario_id") % 11 == 0, 0.5).otherwise(0.0)).withColumn("quote", F.when(F.col("sumario_id") % 13 == 0, "  ").otherwise(F.col("quote")))
    checked = upserts.checked_citations(broken)
    return checked.groupBy("reason").agg(F.count("*").alias("n"))


def constraint_rows(spark, sf_dir):
    """Rows that a load of all citations refuses, over a store that has those of one
    supplier in five and knows the rulings below volume 345."""
    log = citation_log(spark, sf_dir).withColumn("line", F.col("quote")).withColumn("quote", F.when(F.col("sumario_id") % 13 == 0, " ").otherwise(F.format_string("passage %d", F.col("sumario_id") % 3)))
    stored = log.where("sumario_id % 5 = 0 AND sumario_id % 13 <> 0")
    known = rulings(spark, sf_dir).where("volume < 345")
    ends = {"citing_id": "citing ruling missing", "cited_id": "cited ruling missing"}
    checked = upserts.checked_load(upserts.checked_citations(log.where("sumario_id % 5 <> 0")), ["citing_id", "cited_id", "quote"], ["seq_date", "seq_price", "line"], stored, ends, known)
    return checked.where("reason <> 'accepted'").select("citing_id", "cited_id", "line", "reason")


def traces_of_top(spark, sf_dir):
    """What the doctrines of the 15 most cited rulings reach, with all signals."""
    edges, nodes = citations(spark, sf_dir), rulings(spark, sf_dir)
    top = listing.top_cited(edges, 15).select(F.col("cited_id").alias("id"))
    found = trace.reached_from(trace.moving(edges.where("opinion = 'majority'"), nodes), top, 3)
    return found.join(signals.signals(nodes, edges).select("id", "signal", "confidence"), "id", "left").select("start", "id", "depth", "signal", "confidence")


_FLAGS = """,
edge AS (
  SELECT c.*, coalesce(r.decided_year, 0) AS year, coalesce(c.opinion = 'majority', false) AS binding,
         CASE WHEN treatment IN ('applied', 'followed') THEN 'positive' WHEN treatment = 'mentioned' THEN 'neutral'
              WHEN treatment = 'abandoned' THEN 'negative' ELSE 'cautionary' END AS polarity,
         CASE treatment WHEN 'applied' THEN 0 WHEN 'followed' THEN 0 WHEN 'mentioned' THEN 1 WHEN 'distinguished' THEN 2
              WHEN 'limited' THEN 3 WHEN 'criticized' THEN 4 ELSE 5 END AS severity
  FROM citations c JOIN rulings r ON r.id = c.citing_id),
flag AS (
  SELECT *, binding AND polarity = 'negative' AND confidence >= 0.75 AS negative,
         binding AND polarity = 'negative' AND confidence < 0.75 AS weak,
         binding AND polarity = 'cautionary' AS caution, binding AND polarity = 'positive' AS positive FROM edge),
late AS (
  SELECT cited_id, max(year) FILTER (negative) AS last_negative, coalesce(bool_or(negative AND year <= 0), false) AS unknown FROM flag GROUP BY 1),
full_flag AS (
  SELECT f.*, coalesce(f.positive AND NOT l.unknown AND f.year > 0 AND f.year > l.last_negative, false) AS restores FROM flag f JOIN late l USING (cited_id)),
per AS (
  SELECT cited_id, count(DISTINCT citing_id) AS total_citing, count(*) AS n_records, count(*) FILTER (binding) AS n_binding,
         count(*) FILTER (negative) AS n_negative, count(*) FILTER (weak) AS n_weak, count(*) FILTER (caution) AS n_caution,
         count(*) FILTER (positive) AS n_positive, count(*) FILTER (restores) AS n_restoring,
         count(*) FILTER (NOT binding AND polarity = 'negative') AS n_nonbinding_negative,
         count(*) FILTER (binding AND confidence <= 0.25) AS n_unread,
         max(confidence) FILTER (negative) AS cn, max(confidence) FILTER (caution) AS cc, max(confidence) FILTER (positive) AS cp,
         max(confidence) FILTER (restores) AS cr, max(confidence) FILTER (binding) AS cb,
         min({'down': -year, 'citing_id': citing_id, 'year': year}) FILTER (restores) AS newest
  FROM full_flag GROUP BY 1),
report AS (
  SELECT r.id, p.newest, p.cn, p.cc, p.cp, p.cr, p.cb, coalesce(total_citing, 0) AS total_citing, coalesce(n_records, 0) AS n_records, coalesce(n_binding, 0) AS n_binding,
         coalesce(n_negative, 0) AS n_negative, coalesce(n_weak, 0) AS n_weak, coalesce(n_caution, 0) AS n_caution, coalesce(n_positive, 0) AS n_positive,
         coalesce(n_restoring, 0) AS n_restoring, coalesce(n_nonbinding_negative, 0) AS n_nonbinding_negative, coalesce(n_unread, 0) AS n_unread
  FROM rulings r LEFT JOIN per p ON p.cited_id = r.id),
signal AS (
  SELECT *, n_negative > 0 AND n_restoring > 0 AS restored,
         CASE WHEN n_negative > 0 AND n_restoring > 0 THEN 'yellow' WHEN n_negative > 0 THEN 'red' WHEN n_caution > 0 THEN 'yellow' WHEN n_positive > 0 THEN 'green' ELSE 'gray' END AS signal,
         round_even(coalesce(CASE WHEN n_negative > 0 AND n_restoring > 0 THEN cr WHEN n_negative > 0 THEN cn WHEN n_caution > 0 THEN cc WHEN n_positive > 0 THEN cp
                       ELSE least(coalesce(cb, 0), 0.5) END, 0), 3)::DOUBLE AS confidence,
         NOT (n_negative + n_weak > 0 AND n_positive > 0) AS is_uniform
  FROM report)
"""

_MOVING = "treatment IN ('applied', 'followed', 'distinguished', 'limited', 'criticized', 'abandoned')"
_BFS = """,
hop AS (SELECT DISTINCT c.cited_id, c.citing_id FROM citations c JOIN rulings r ON r.id = c.citing_id WHERE {moving} {only}),
walk AS (
  SELECT '{asked}' AS id, 0 AS depth
  UNION
  SELECT h.citing_id, w.depth + 1 FROM walk w JOIN hop h ON h.cited_id = w.id WHERE w.depth < 3),
seen AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1),
steps AS (
  SELECT s.depth, c.cited_id AS from_id, c.citing_id AS to_id, r.decided_year AS year, c.treatment, c.opinion, c.confidence, c.quote
  FROM citations c JOIN rulings r ON r.id = c.citing_id JOIN seen s ON s.id = c.cited_id WHERE s.depth < 3 AND {moving} {only})
"""


def _bfs(only: str = "") -> str:
    return GRAPH_SQL.replace("WITH rulings", "WITH RECURSIVE rulings") + _BFS.format(moving=_MOVING, asked=ASKED, only=only)


_RULING = "r.id, r.volume, r.page, r.caption, r.decided_year, r.text_status"
_BROKEN = "confidence + CASE WHEN sumario_id % 11 = 0 THEN 0.5 ELSE 0 END AS confidence, CASE WHEN sumario_id % 13 = 0 THEN '  ' ELSE quote END AS quote"

SQL = {
    "signal_status": GRAPH_SQL + _FLAGS + f"SELECT {', '.join(_REPORT)} FROM signal",
    "signal_caveats": GRAPH_SQL
    + _FLAGS
    + """SELECT id, concat_ws(' | ',
  CASE WHEN n_records = 0 THEN 'No hay fallos posteriores que lo citen en el corpus. Ausencia de tratamiento negativo no equivale a vigencia confirmada.' END,
  CASE WHEN n_records > 0 AND signal = 'gray' THEN 'Lo citan ' || total_citing || ' fallo(s), pero ninguna cita pudo clasificarse como tratamiento. Gris significa que no se sabe, no que el precedente esté confirmado.' END,
  CASE WHEN restored THEN 'El precedente fue abandonado y después retomado: ' || replace(newest.citing_id, 'fallos:', 'Fallos: ') || ' (' || newest.year || ') vuelve a él. La señal no es roja por eso, pero la historia importa para citarlo: revisar el detalle antes de apoyarse en él.' END,
  CASE WHEN n_nonbinding_negative > 0 THEN n_nonbinding_negative || ' tratamiento(s) negativo(s) provienen de disidencias o votos propios. No son doctrina del tribunal y no determinan la señal.' END,
  CASE WHEN n_weak > 0 THEN n_weak || ' tratamiento(s) clasificado(s) como negativo(s) por debajo del umbral de confianza (0.75). Figuran en el detalle pero no encienden la señal roja.' END,
  CASE WHEN NOT is_uniform THEN 'El fallo fue abandonado en algún punto y aplicado en otro. La vigencia no es uniforme: revisar el detalle por tratamiento.' END,
  CASE WHEN n_records > 0 AND n_binding = 0 THEN 'Ninguno de los tratamientos pudo atribuirse al voto de la mayoría. La señal es indeterminada, no positiva.' END,
  CASE WHEN n_binding > 0 AND signal IN ('green', 'yellow') AND n_unread * 2 > n_binding THEN 'Solo ' || (n_binding - n_unread) || ' de ' || n_binding || ' citas de la mayoría pudieron clasificarse; el resto quedó sin leer. La señal descansa en esa minoría y podría cambiar si se clasificaran las demás.' END,
  CASE WHEN signal = 'red' THEN 'Señal roja: verificar el pasaje citado antes de descartar el precedente. Esta es una herramienta de investigación, no un dictamen.' END) AS caveats
FROM signal""",
    "signal_evidence": GRAPH_SQL
    + _FLAGS
    + """SELECT cited_id, rank, citing_id, treatment, opinion, confidence, year, quote FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cited_id ORDER BY severity DESC, confidence DESC, year DESC, citing_id, quote, treatment, opinion, method) AS INT) AS rank FROM edge)
WHERE rank <= 10""",
    "treatment_counts": GRAPH_SQL + "SELECT cited_id, treatment, count(*) AS n, count(*) FILTER (opinion = 'majority') AS n_binding FROM citations GROUP BY 1, 2",
    "treatment_pivot": GRAPH_SQL + "SELECT cited_id, " + ", ".join(f"count(*) FILTER (treatment = '{t}') AS {t}" for t in ("applied", "followed", "mentioned", "distinguished", "limited", "criticized", "abandoned")) + " FROM citations GROUP BY 1",
    "nonbinding_by_opinion": GRAPH_SQL + "SELECT cited_id, opinion, count(*) AS n FROM citations WHERE opinion <> 'majority' GROUP BY 1, 2",
    "citing_page": GRAPH_SQL + f"SELECT DISTINCT {_RULING} FROM citations c JOIN rulings r ON r.id = c.citing_id WHERE c.cited_id = '{ASKED}' ORDER BY decided_year DESC, volume DESC, page DESC LIMIT 20",
    "citing_page_filtered": GRAPH_SQL + f"SELECT DISTINCT {_RULING} FROM citations c JOIN rulings r ON r.id = c.citing_id WHERE c.cited_id = '{ASKED}' AND c.treatment = 'followed' ORDER BY decided_year DESC, volume DESC, page DESC LIMIT 50 OFFSET 1",
    "cited_page": GRAPH_SQL + f"SELECT DISTINCT {_RULING} FROM citations c JOIN rulings r ON r.id = c.cited_id WHERE c.citing_id = '{ASKED}' ORDER BY decided_year, volume, page LIMIT 5 OFFSET 2",
    "citing_totals": GRAPH_SQL + "SELECT cited_id, count(DISTINCT citing_id) AS total FROM citations GROUP BY 1",
    "top_cited": GRAPH_SQL + "SELECT cited_id, count(DISTINCT citing_id) AS total FROM citations GROUP BY 1 ORDER BY total DESC, cited_id LIMIT 15",
    "citers_of_top": GRAPH_SQL + "SELECT DISTINCT citing_id FROM citations WHERE cited_id IN (SELECT cited_id FROM citations GROUP BY 1 ORDER BY count(DISTINCT citing_id) DESC, cited_id LIMIT 15)",
    "status_counts": GRAPH_SQL + "SELECT text_status, count(*) AS n FROM rulings GROUP BY 1",
    "whole_graph_counts": GRAPH_SQL + "SELECT treatment, count(*) AS n FROM citations GROUP BY 1",
    "provenance": GRAPH_SQL
    + """SELECT *, round_even(100.0::DOUBLE * stance / edges, 1) AS stance_percent, round_even(100.0::DOUBLE * attributed / edges, 1) AS attributed_percent, replace(format('{:,}', edges), ',', '.') AS edges_text
FROM (SELECT count(*) AS edges, count(*) FILTER (treatment <> 'mentioned') AS stance, count(*) FILTER (opinion <> 'unknown') AS attributed, count(*) FILTER (opinion = 'majority') AS majority FROM citations),
     (SELECT count(*) AS nodes, count(*) FILTER (text_status = 'extracted') AS extracted, count(*) FILTER (text_status = 'ocr') AS ocr, count(*) FILTER (volume BETWEEN 310 AND 329) AS inside, count(*) FILTER (volume NOT BETWEEN 310 AND 329) AS stubs FROM rulings)
WHERE edges > 0""",
    "point_lookup": GRAPH_SQL + f"SELECT * FROM rulings WHERE id = '{ASKED}'",
    "volume_range": GRAPH_SQL + "SELECT id, volume, decided_year FROM rulings WHERE volume < 310 OR volume > 329",
    "already_read": GRAPH_SQL + "SELECT id, text_status FROM rulings WHERE text_status <> 'unavailable'",
    "unclassified_edges": GRAPH_SQL + "SELECT citing_id, cited_id, quote, confidence FROM citations WHERE method <> 'manual' AND confidence <= 0.25 AND quote NOT ILIKE 'Referencia publicada por la CSJN%'",
    "trace_steps": _bfs("AND c.opinion = 'majority'") + "SELECT * FROM steps",
    "trace_chain": _bfs() + "SELECT * FROM steps ORDER BY year, depth, from_id, to_id, treatment, quote LIMIT 40",
    "trace_signals": _bfs("AND c.opinion = 'majority'") + _FLAGS + "SELECT s.id, s.depth, g.signal, g.confidence FROM seen s LEFT JOIN signal g USING (id)",
    "upsert_citations": GRAPH_SQL
    + """SELECT citing_id, cited_id, quote, arg_max(treatment, k) AS treatment, arg_max(opinion, k) AS opinion, arg_max(confidence, k) AS confidence, arg_max(method, k) AS method, arg_min(sumario_id, k) AS sumario_id
FROM (SELECT *, row_number() OVER (ORDER BY seq_date, seq_price, sumario_id) AS k FROM citation_log) GROUP BY 1, 2, 3""",
    "upsert_rulings": """WITH log AS (
  SELECT 'fallos:' || (300 + o_custkey % 50) || ':' || (1 + CAST(floor(o_custkey / 50.0) AS INT)) AS id, CAST(300 + o_custkey % 50 AS INT) AS volume, CAST(1 + floor(o_custkey / 50.0) AS INT) AS page,
         o_orderpriority AS caption, CAST(year(o_orderdate) AS INT) AS decided_year, CASE WHEN o_orderstatus = 'F' THEN 'extracted' ELSE 'unavailable' END AS text_status, o_orderkey AS seq,
         CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS text_quality, CASE WHEN o_orderkey % 3 = 0 THEN 'N' || o_orderkey END AS short_name,
         CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS decided_on, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END AS csjn_doc_id FROM orders),
last AS (SELECT id, max(seq) AS seq, min(volume) AS volume, min(page) AS page, arg_max(short_name, seq) FILTER (short_name IS NOT NULL) AS short_name,
                arg_max(decided_on, seq) FILTER (decided_on IS NOT NULL) AS decided_on, arg_max(csjn_doc_id, seq) FILTER (csjn_doc_id IS NOT NULL) AS csjn_doc_id FROM log GROUP BY id)
SELECT a.id, a.volume, a.page, l.caption, l.decided_year, 'u' AS source_url, l.text_status, l.text_quality, a.short_name, a.decided_on, a.csjn_doc_id FROM last a JOIN log l USING (id, seq)""",
    "upsert_aliases": """SELECT raw, arg_max(ruling_id, seq) AS ruling_id, arg_min(form, seq) AS form, arg_min(source, seq) AS source FROM (
  SELECT 'ALIAS ' || (o_orderkey % 97) AS raw, 'fallos:' || (300 + o_custkey % 50) || ':' || (1 + CAST(floor(o_custkey / 50.0) AS INT)) AS ruling_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'caption' ELSE 'short_name' END AS form, CASE WHEN o_orderkey % 3 = 0 THEN 'csjn' ELSE 'manual' END AS source, o_orderkey AS seq
  FROM orders WHERE o_orderkey % 11 <> 0) GROUP BY 1""",
    "stub_nodes": GRAPH_SQL
    + """SELECT id, CAST(split_part(id, ':', 2) AS INT) AS volume, CAST(split_part(id, ':', 3) AS INT) AS page, replace(id, 'fallos:', 'Fallos: ') AS caption, 0 AS decided_year, 'unavailable' AS text_status
FROM (SELECT citing_id AS id FROM citations UNION SELECT cited_id FROM citations) WHERE id NOT IN (SELECT id FROM rulings WHERE volume < 340)""",
    "constraint_rows": GRAPH_SQL
    + """, l AS (SELECT *, quote AS line, CASE WHEN sumario_id % 13 = 0 THEN ' ' ELSE 'passage ' || (sumario_id % 3) END AS q FROM citation_log),
had AS (SELECT DISTINCT citing_id, cited_id, q FROM l WHERE sumario_id % 5 = 0 AND sumario_id % 13 <> 0),
known AS (SELECT id FROM rulings WHERE volume < 345),
r AS (SELECT l.*, CASE WHEN trim(l.q) = '' THEN 'blank quote' WHEN l.citing_id NOT IN (SELECT id FROM known) THEN 'citing ruling missing' WHEN l.cited_id NOT IN (SELECT id FROM known) THEN 'cited ruling missing'
                       WHEN h.q IS NOT NULL THEN 'stored before' ELSE 'accepted' END AS reason
      FROM l LEFT JOIN had h ON h.citing_id = l.citing_id AND h.cited_id = l.cited_id AND h.q = l.q WHERE l.sumario_id % 5 <> 0)
SELECT citing_id, cited_id, line, CASE WHEN reason = 'accepted' THEN 'repeated in the load' ELSE reason END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY citing_id, cited_id, q, reason ORDER BY seq_date, seq_price, line) AS place FROM r) WHERE reason <> 'accepted' OR place > 1""",
    "traces_of_top": GRAPH_SQL.replace("WITH rulings", "WITH RECURSIVE rulings")
    + f""",
hop AS (SELECT DISTINCT c.cited_id, c.citing_id FROM citations c JOIN rulings r ON r.id = c.citing_id WHERE {_MOVING} AND c.opinion = 'majority'),
top AS (SELECT cited_id FROM citations GROUP BY 1 ORDER BY count(DISTINCT citing_id) DESC, cited_id LIMIT 15),
walk AS (
  SELECT cited_id AS start, cited_id AS id, 0 AS depth FROM top
  UNION
  SELECT w.start, h.citing_id, w.depth + 1 FROM walk w JOIN hop h ON h.cited_id = w.id WHERE w.depth < 3),
seen AS (SELECT start, id, min(depth) AS depth FROM walk GROUP BY 1, 2)
"""
    + _FLAGS
    + "SELECT s.start, s.id, s.depth, g.signal, g.confidence FROM seen s LEFT JOIN signal g USING (id)",
    "constraint_reject": GRAPH_SQL
    + f"""SELECT CASE WHEN length(trim(quote)) = 0 THEN 'blank quote' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' ELSE 'accepted' END AS reason, count(*) AS n
FROM (SELECT {_BROKEN} FROM citation_log) GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
