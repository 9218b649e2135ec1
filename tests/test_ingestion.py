"""Reading documents into a stored graph, and the evaluation of the rules."""

import pytest
from pyspark.sql import functions as F

from prudentia.api import StoredGraph
from prudentia.operators import evaluation
from prudentia.operators.batches import ingest_into
from prudentia.plans import evaluation_queries
from prudentia.schema import CITATIONS, RULINGS
from prudentia.sources.store import CommitConflict, GraphStore

WORDS = "La Corte resuelve que corresponde confirmar la sentencia apelada en todo lo demás. "
TEXT = "id string, text string"


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture
def store(spark, tmp_path):
    known = [("fallos:310:1", 310, 1, "CASO UNO", "Uno", "01/02/1987", 1987, "u", "unavailable", None, 5), ("fallos:310:2", 310, 2, "CASO DOS", None, None, 1988, "u", "ocr", 0.9, None)]
    return GraphStore.create(spark, f"file://{tmp_path}/g", spark.createDataFrame(known, RULINGS), spark.createDataFrame([], CITATIONS))


def test_write_back(spark, store):
    docs = spark.createDataFrame(
        [
            ("fallos:310:1", WORDS + "Que corresponde apartarse de la doctrina de Fallos: 300:7. Que rige Fallos: 310:2; 310:1."),
            ("fallos:310:1", WORDS + "Que corresponde apartarse de la doctrina de Fallos: 300:7. Que rige Fallos: 310:2; 310:1."),
            ("fallos:310:2", WORDS + "Que rige Fallos: 300:9."),  # read before
            ("fallos:311:4", WORDS + "Que cabe estar a lo decidido en Fallos: 310:1."),
            ("fallos:311:5", "x1 %% 77 ## zz 00 -- ==" * 20),
            ("fallos:311:6", None),
            ("fallos:311:7", " \n"),
            ("fallos:900:1", WORDS),
            ("expediente 7", WORDS),
            (None, WORDS),
        ],
        TEXT,
    )
    records = spark.createDataFrame([("fallos:311:4", "CASO CUATRO", 1988)] * 2, "id string, caption string, decided_year int")
    after, report = ingest_into(store, docs, records)
    assert after.version == store.version + 1 and after.meta == {"sources": "pipeline"}
    told = {r.id: (r.text_status, r.n_edges, r.error) for r in report.collect()}
    assert told == {
        "fallos:310:1": ("extracted", 2, None), "fallos:311:4": ("extracted", 1, None), "fallos:311:5": ("garbled", 0, "text below the quality floor"), "fallos:311:6": ("unavailable", 0, "no text"),
        "fallos:311:7": ("unavailable", 0, "no text"), "fallos:900:1": (None, 0, "not a ruling's id"), "expediente 7": (None, 0, "not a ruling's id"), None: (None, 0, "not a ruling's id"),
    }
    nodes = {r.id: r for r in after.rulings.collect()}
    assert set(nodes) == {"fallos:310:1", "fallos:310:2", "fallos:300:7", "fallos:311:4", "fallos:311:5", "fallos:311:6", "fallos:311:7"}
    one = nodes["fallos:310:1"]
    assert (one.caption, one.short_name, one.decided_on, one.decided_year, one.csjn_doc_id, one.text_status) == ("CASO UNO", "Uno", "01/02/1987", 1987, 5, "extracted") and one.text_quality > 0.7
    assert (nodes["fallos:310:2"].caption, nodes["fallos:310:2"].text_status) == ("CASO DOS", "ocr")
    assert (nodes["fallos:311:4"].caption, nodes["fallos:311:4"].decided_year) == ("CASO CUATRO", 1988)
    assert (nodes["fallos:300:7"].caption, nodes["fallos:300:7"].text_status, nodes["fallos:300:7"].decided_year) == ("Fallos: 300:7", "unavailable", 0)
    found = {(r.citing_id, r.cited_id): (r.treatment, r.method) for r in after.citations.collect()}
    assert found[("fallos:310:1", "fallos:300:7")] == ("abandoned", "rule") and found[("fallos:311:4", "fallos:310:1")] == ("followed", "rule") and len(found) == 3
    graph = StoredGraph(after)
    assert graph.status("Fallos: 300:7")["signal"] == "red" and graph.lookup("fallos:311:4")["text_status"] == "extracted"
    traced = graph.trace("Fallos: 300:7")
    assert traced["reached"] == sum(traced["reached_by_signal"].values()) >= 2 and traced["reached_by_signal"]["red"] == 1

    # the same again: what was read isn't asked for; read again, nothing changes
    resumed, report = ingest_into(after, docs, records)
    assert {r.id for r in report.where("text_status = 'extracted'").collect()} == set()
    again, report = ingest_into(resumed, docs.where(F.col("id") != "fallos:310:2"), records, again=True, source="second")
    assert rows(again.rulings) == rows(after.rulings) and rows(again.citations) == rows(after.citations) == rows(again.table("citing"))
    assert again.meta == {"sources": "pipeline + second"}
    with pytest.raises(CommitConflict):
        ingest_into(store, docs)


def test_nothing_to_read(spark, store):
    after, report = ingest_into(store, spark.createDataFrame([], TEXT))
    assert report.isEmpty() and rows(after.rulings) == rows(store.rulings) and after.citations.isEmpty()


def test_every_rule_has_a_wording(spark):
    found = evaluation_queries._read(spark, "/root/testdata/sf0.001").where("frame = 'plain'")
    assert {r.rule for r in found.select("rule").distinct().collect()} == {r[1] for r in evaluation_queries.RULES}


def test_gate(spark):
    rows = [("abandoned", "abandoned"), ("abandoned", "mentioned"), ("applied", "applied"), (None, "mentioned")]
    frame = spark.createDataFrame(rows, "expected string, got string")
    report = evaluation.evaluation(evaluation.confusion(frame))
    assert tuple(report.first()) == (4, 2, 0, 1)
    evaluation.gate(report)
    worse = evaluation.evaluation(evaluation.confusion(frame.union(spark.createDataFrame([("applied", "abandoned"), (None, "abandoned")], frame.schema))))
    assert tuple(worse.first()) == (6, 2, 2, 1)
    with pytest.raises(evaluation.FalseRed):
        evaluation.gate(worse)
    none = evaluation.evaluation(evaluation.confusion(frame.limit(0)))
    assert tuple(none.first()) == (0, 0, 0, 0)
    evaluation.gate(none)
