"""Fixtures of hand-read cases and PDF files."""

import json
from hashlib import sha256

from prudentia.api import StoredGraph
from prudentia.schema import ALIASES, CITATIONS, RULINGS
from prudentia.sources import records
from prudentia.sources.store import GraphStore

CASES = {
    "rulings": [
        {"id": "fallos:310:1", "volume": 310, "page": 1, "caption": "Pérez, Juan c/ Estado", "short_name": "“Pérez”", "decided_on": "01/02/1987", "decided_year": 1987, "source_url": "u", "text_status": "ocr", "remark": "not a column"},
        {"id": "fallos:311:2", "volume": 311, "page": 2, "caption": "Gómez", "short_name": None, "decided_year": 1988, "source_url": "u", "text_status": "ocr"},
        {"volume": 9, "page": 9, "caption": "nobody"},
    ],
    "aliases": [["P.1.XX", "expediente", "fallos:310:1"], ["", "caption", "fallos:310:1"], ["lost", "caption"], ["fallos:311:2", "fallos", "fallos:311:2"]],
    "edges": [
        {"citing_id": "fallos:311:2", "cited_id": "fallos:310:1", "treatment": "abandoned", "opinion": "majority", "confidence": 1.0, "quote": "se aparta", "method": "manual"},
        {"citing_id": "fallos:311:2", "treatment": "followed"},
    ],
}


def test_fixture(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps(CASES, indent=1), encoding="utf-8")
    path = f"file://{tmp_path}/cases.json"
    rulings, edges, aliases = records.read_fixture(spark, path)
    assert rulings.columns == RULINGS.names and edges.columns == CITATIONS.names and aliases.columns == ALIASES.names
    assert [(r.id, r.volume, r.short_name, r.decided_on, r.text_quality) for r in rulings.orderBy("id").collect()] == [("fallos:310:1", 310, "“Pérez”", "01/02/1987", None), ("fallos:311:2", 311, None, None, None)]
    assert [(r.citing_id, r.treatment, r.confidence, r.sumario_id) for r in edges.collect()] == [("fallos:311:2", "abandoned", 1.0, None)]
    assert sorted((r.ruling_id, r.form, r.raw) for r in aliases.collect()) == [
        ("fallos:310:1", "caption", "PEREZ JUAN ESTADO"), ("fallos:310:1", "expediente", "P.1.XX"), ("fallos:310:1", "fallos", "fallos:310:1"), ("fallos:310:1", "short_name", "PEREZ"),
        ("fallos:311:2", "caption", "GOMEZ"), ("fallos:311:2", "fallos", "fallos:311:2"),
    ]
    empty = [spark.createDataFrame([], s) for s in (RULINGS, CITATIONS, ALIASES)]
    store = records.load_fixture(GraphStore.create(spark, f"file://{tmp_path}/g", *empty), path)
    graph = StoredGraph(store)
    assert graph.lookup("“Pérez”")["id"] == graph.lookup("P.1.XX")["id"] == "fallos:310:1"
    assert graph.status("Fallos: 310:1")["by_treatment"] == {"abandoned": 1} and graph.corpus()["sources"] == "fixture"
    again = records.load_fixture(store, path)
    for name in ("rulings", "citations", "aliases"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(store, name).collect()))
    assert again.meta == {"sources": "fixture"}


def test_fixture_without_lists(spark, tmp_path):
    (tmp_path / "none.json").write_text("{}", encoding="utf-8")
    assert [t.count() for t in records.read_fixture(spark, f"file://{tmp_path}/none.json")] == [0, 0, 0]


def test_pdfs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MAX_PDF_BYTES", 100)
    files = {"a.pdf": b"%PDF-1.4 a", "page.pdf": b"<html>not found</html>", "empty.pdf": b"", "large.pdf": b"%PDF" + b"x" * 97, "edge.pdf": b"%PDF" + b"x" * 96, "b.txt": b"%PDF"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (bytes(r.content), r.digest) for r in records.read_pdfs(spark, f"file://{tmp_path}").collect()}
    assert got == {n: (files[n], sha256(files[n]).hexdigest()) for n in ("a.pdf", "edge.pdf")}
