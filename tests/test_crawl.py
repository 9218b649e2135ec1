"""The stored crawl as a source, its stream, and the state of its volumes."""

import json
import os
from pathlib import Path

import duckdb
import pytest

from prudentia.plans import crawl_queries
from prudentia.sources import crawl
from prudentia.streaming.completion import done_volumes, mark_volumes, volumes
from prudentia.streaming.ingest import folded, folded_aliases, ingest_pages

FOLDER = "/root/testdata/sf0.001"
read, down, expired, gone = ({"status": s, "body": b} for s, b in ((200, '[{"a": 1}]'), (503, ""), (401, ""), (404, "")))
broken = {"status": 0, "body": None}


@pytest.mark.parametrize(
    ("attempts", "expected"),
    [
        ([read], [{"a": 1}]), ([down, read], [{"a": 1}]), ([down, broken, read], [{"a": 1}]), ([down, down, down, read], None), ([expired, read], [{"a": 1}]),
        ([down, down, expired, down, down, read], [{"a": 1}]), ([expired, expired, read], None), ([gone, read], None), ([], None), ([{"status": 200, "body": "{}"}], []), ([{"status": 200, "body": "<html>"}], None),
    ],
)
def test_attempts(attempts, expected):
    assert crawl.replayed(attempts) == expected


def test_totals():
    assert crawl.scraped_total('x var totalResultados = "3514"; y') == 3514 and crawl.scraped_total("nothing") == 0


def record(ident, volume, page, *citing, **more):
    links = "".join(f"<a> Fallos: {c} </a>" for c in citing)
    return {"id": ident, "tomo": volume, "pagina": page, "caratulaWeb": f"CASE {ident}", "fechaString": "1986", "linksCitantes": links, **more}


def store(spark, folder, run, totals, pages, volumes=349):
    """totals: {volume: total}; pages: {(volume, start): attempts}."""
    searches = spark.createDataFrame([(v, f'<b>\n var totalResultados = "{n}"</b>' if n else "none") for v, n in totals.items()], "volume int, html string")
    rows = [(v, s, [(a["status"], a["body"]) for a in attempts]) for (v, s), attempts in pages.items()]
    crawl.store_run(spark, folder, run, volumes, searches, spark.createDataFrame(rows, "volume int, start int, attempts array<struct<status: int, body: string>>"))


def page_of(*records):
    return [{"status": 200, "body": json.dumps(records)}]


@pytest.fixture
def folder(spark, tmp_path):
    path = f"file://{tmp_path}/crawl"
    ten = [record(i, 331, i) for i in range(1, 11)]
    pages = {
        (331, 0): page_of(*ten), (331, 10): [down] * 3, (331, 20): page_of(record(21, 331, 21, "332:7", "331:21")),
        (332, 0): page_of(record(30, 332, 1, numeroExpediente="A. 891. XLIV. RHE"), record(31, 332, None), {"id": 32}, 5), (332, 10): page_of(), (332, 20): page_of(record(33, 332, 3)),
        (400, 0): page_of(record(40, 400, 1)),
    }
    store(spark, path, 1, {331: 21, 332: 25, 333: 0, 400: 1}, pages, volumes=350)
    return path


def test_rows_and_states(spark, folder):
    rows = crawl.read_crawl(spark, folder).collect()
    assert {r.volume for r in rows} == {331, 332}  # 333 has no records, 400 is beyond the number of volumes
    seen = {(r.volume, r.start, r.state): 0 for r in rows}
    for r in rows:
        seen[r.volume, r.start, r.state] += r.record is not None
    assert seen == {(331, 0, "read"): 10, (331, 10, "lost"): 0, (331, 20, "read"): 1, (332, 0, "read"): 1, (332, 10, "empty"): 0}
    assert {r.total for r in rows if r.volume == 332} == {25}
    limited = crawl.read_crawl(spark, folder, limit=1, volumes="331").collect()
    assert len(limited) == 10 and {r.start for r in limited} == {0}
    assert {r.volume for r in crawl.read_crawl(spark, folder, skip="331,9").collect()} == {332}


@pytest.mark.parametrize(("condition", "left"), [("volume = 332", {332}), ("volume IN (331, 400)", {331}), ("volume > 331 AND start = 0", {332}), ("volume <= 331", {331}), ("volume < 300", set()), ("volume = 331 OR start = 10", {331, 332})])
def test_conditions_leave_partitions_out(spark, folder, condition, left):
    asked = crawl.read_crawl(spark, folder).where(condition)
    whole = spark.createDataFrame(crawl.read_crawl(spark, folder).collect(), crawl.SCHEMA)
    assert sorted(map(str, asked.collect())) == sorted(map(str, whole.where(condition).collect()))
    assert {r.volume for r in asked.collect()} == left
    planned = asked.rdd.getNumPartitions()
    assert planned == (2 if "OR" in condition else 1)


def test_pruned_volumes_are_never_opened(spark, folder):
    path = folder.removeprefix("file://")
    for name in os.listdir(f"{path}/run=1/pages/volume=331"):
        with open(f"{path}/run=1/pages/volume=331/{name}", "w") as file:
            file.write("not json")
    for name in list(os.listdir(f"{path}/run=1/pages/volume=331")):
        if name.endswith(".crc"):
            os.remove(f"{path}/run=1/pages/volume=331/{name}")
    assert crawl.read_crawl(spark, folder).where("volume = 332").count() == 2
    with pytest.raises(Exception):
        crawl.read_crawl(spark, folder).collect()


def test_volumes_stay_open_until_no_page_is_missing(spark, folder, tmp_path):
    logs, states = f"{tmp_path}/logs", f"{tmp_path}/states"

    def go():  # each call is a new query that finds its state in the checkpoint
        ingest_pages(crawl.stream_crawl(spark, folder), logs, f"{states}/a").awaitTermination()
        mark_volumes(spark, logs, f"{states}/b").awaitTermination()
        return {r.volume: tuple(r)[1:] for r in volumes(spark, logs).collect()}

    first = {331: (21, 2, 1, 1, False), 332: (25, 1, 0, 0, True)}  # 332 ends at its empty page
    assert go() == first and done_volumes(spark, logs) == "332"
    assert go() == first
    # A later run brings nothing but repeats, another loses the page again, the last brings it.
    store(spark, folder, 2, {331: 21}, {(331, 0): page_of(record(1, 331, 1))}, 350)
    assert go()[331] == (21, 2, 1, 1, False)
    store(spark, folder, 3, {331: 21}, {(331, 10): [expired, expired]}, 350)
    assert go()[331] == (21, 2, 1, 1, False)
    again = record(11, 331, 11) | {"caratulaWeb": "first said"}, record(11, 331, 11) | {"caratulaWeb": "said last"}
    store(spark, folder, 4, {331: 21}, {(331, 10): page_of(*again)}, 350)
    assert go()[331] == (21, 3, 0, 0, True) and done_volumes(spark, logs) == "331,332"
    assert crawl.read_crawl(spark, folder, skip=done_volumes(spark, logs)).isEmpty()
    # The search finds more records than before: the volume is open again.
    store(spark, folder, 5, {332: 31}, {(332, 0): page_of(record(30, 332, 1)), (332, 10): page_of(record(34, 332, 4)), (332, 30): page_of(record(35, 332, 5))}, 350)
    assert go()[332] == (31, 3, 1, 1, False)
    rulings, edges = folded(spark, logs)
    said = {r.id: r.caption for r in rulings.collect()}
    assert said["fallos:331:11"] == "said last" and said["fallos:332:7"] == "Fallos: 332:7"  # the later record of a page wins
    assert [(r.citing_id, r.cited_id, r.quote) for r in edges.collect()] == [("fallos:332:7", "fallos:331:21", "Referencia publicada por la CSJN en el sumario 21 de Fallos: 331:21. Sin clasificar: falta el pasaje.")]
    names = {(r.raw, r.form): r.ruling_id for r in folded_aliases(spark, logs).collect()}
    assert names["A.891.XLIV", "expediente"] == "fallos:332:1" == names["fallos:332:1", "fallos"]


def test_an_undone_run_is_not_read(spark, folder):
    store(spark, folder, 2, {332: 1}, {(332, 0): page_of(record(50, 332, 9))}, 350)
    Path(folder.removeprefix("file://"), "run=2", "_DONE").unlink()
    assert {r.run for r in crawl.read_crawl(spark, folder).collect()} == {1}


@pytest.mark.parametrize("name", list(crawl_queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{FOLDER}/part.parquet'")
    found = crawl_queries.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    cursor = con.execute(crawl_queries.SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(str([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
    assert sorted(names) == columns and sorted(str(list(r)) for r in found.select(*columns).collect()) == want and want
