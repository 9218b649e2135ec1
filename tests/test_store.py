"""The stored graph: what its files are, what merges leave alone, what questions open."""

import random

import pytest
from pyspark.sql import functions as F

from prudentia.api import CitationGraph, StoredGraph
from prudentia.operators.upserts import fold_citations, fold_rulings
from prudentia.schema import ALIASES, CITATIONS, RULINGS
from prudentia.sources import store as stores
from prudentia.sources.store import CommitConflict, GraphStore, GraphUnavailable


def ruling(k, caption="c", **more):
    row = {"id": f"fallos:{300 + k % 20}:{k}", "volume": 300 + k % 20, "page": k, "caption": caption, "short_name": None, "decided_on": None, "decided_year": 1950 + k % 60, "source_url": "u", "text_status": "ocr", "text_quality": None, "csjn_doc_id": None}
    return tuple((row | more).values())


def name(k):
    return f"fallos:{300 + k % 20}:{k}"


def edge(a, b, quote, treatment="followed", **more):
    row = {"citing_id": name(a), "cited_id": name(b), "treatment": treatment, "opinion": "majority", "confidence": 0.9, "quote": quote, "method": "rule", "sumario_id": None}
    return tuple((row | more).values())


def frames(spark, rulings, edges, aliases=()):
    return spark.createDataFrame(rulings, RULINGS), spark.createDataFrame(edges, CITATIONS), spark.createDataFrame(list(aliases), ALIASES)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(2)
    nodes = [ruling(k) for k in range(1, 401)]
    edges = [edge(rng.randint(1, 400), 7 if i % 3 == 0 else rng.randint(1, 400), f"q{i}") for i in range(3000)]  # a third cite one ruling
    return nodes, edges


@pytest.fixture
def built(spark, made, tmp_path):
    return GraphStore.create(spark, f"file://{tmp_path}/a graph?#", *frames(spark, *made, [(f"NAME {k}", name(k), "caption", "csjn") for k in range(1, 401)]), rows=300)


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_ranges_and_lookups(spark, made, built):
    nodes, edges, _ = frames(spark, *made)
    assert rows(built.rulings) == rows(nodes) and rows(built.citations) == rows(edges) == rows(built.table("citing"))
    assert len(built.files("citations")) >= 5 and all(len(f) <= 1 for f in built.files("citations").values())
    for asked in (name(7), name(200), "fallos:1:1", "zzz", ""):
        assert rows(built.lookup("citations", asked)) == rows(edges.where(F.col("cited_id") == asked))
        assert rows(built.lookup("citing", asked)) == rows(edges.where(F.col("citing_id") == asked))
        assert rows(built.lookup("rulings", asked)) == rows(nodes.where(F.col("id") == asked))
    some = edges.where(F.col("cited_id") == name(9))
    near = built.matching("rulings", some, "citing_id")
    assert rows(some.join(near, F.col("citing_id") == near["id"])) == rows(some.join(nodes, F.col("citing_id") == nodes["id"]))


def scanned(frame):
    """(files, rows) that the scan of a filter-only query has read."""
    frame.collect()
    todo, found = [frame._jdf.queryExecution().executedPlan()], [0, 0]
    while todo:
        plan = todo.pop()
        metrics = plan.metrics()
        if metrics.contains("numFiles"):
            found[0] += metrics.apply("numFiles").value()
            found[1] += metrics.apply("numOutputRows").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return tuple(found)


def test_a_lookup_reads_few_files_and_rows(spark, tmp_path):
    edges = [edge(k % 999, k // 20, f"quote {k} " + "x" * 40) for k in range(40_000)]
    spark.conf.set("parquet.block.size", "65536")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    try:
        store = GraphStore.create(spark, f"{tmp_path}/g", *frames(spark, [ruling(k) for k in range(2000)], edges), rows=10_000)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
    whole = scanned(store.citations)
    files, read = scanned(store.lookup("citations", name(500)))
    assert whole[1] == 40_000 and files < whole[0] and read < 4_000  # a range has 10,000 rows, of which row groups and pages are left out
    assert store.lookup("citations", name(500)).count() == 20


def test_a_merge_writes_only_what_it_touches(spark, made, built):
    before = built.files("citations"), built.files("rulings")
    batch = [edge(1, 300, "new"), edge(2, 300, "again", "followed", sumario_id=5)]
    touched = {stores.bisect_right(built.manifest["tables"]["citations"]["bounds"], name(300))}
    merged = built.merge(citations=frames(spark, [], batch)[1])
    for k, files in merged.files("citations").items():
        assert files[: len(before[0][k])] == before[0][k] and (len(files) > len(before[0][k])) == (k in touched)
    assert merged.files("rulings") == before[1]
    second = merged.merge(citations=frames(spark, [], [edge(2, 300, "again", "criticized", sumario_id=9)])[1])
    assert [(r.treatment, r.sumario_id) for r in second.lookup("citations", name(300)).where("quote = 'again'").collect()] == [("criticized", 5)]
    assert second.table("citing").where("quote = 'again'").count() == 1
    compacted = second.compact()
    for k, files in compacted.files("citations").items():
        assert (files == before[0][k]) == (k not in touched)
    assert not any(p["log"] for t in compacted.manifest["tables"].values() for p in t["ranges"])
    assert rows(compacted.citations) == rows(second.citations) and rows(compacted.table("citing")) == rows(second.table("citing"))
    # Who opened an older commit goes on reading it.
    assert rows(built.citations) == rows(frames(spark, *made)[1]) == rows(GraphStore(spark, built.folder, 0).citations)


def test_merges_equal_the_fold_of_everything(spark, tmp_path):
    rng, writes, notes = random.Random(4), [], []
    for i in range(1500):
        writes.append((*edge(rng.randint(1, 30), rng.randint(31, 60), f"q{rng.randint(1, 3)}", rng.choice(["followed", "criticized"]), sumario_id=rng.choice([None, i])), i))
        notes.append((*ruling(rng.randint(1, 40), f"c{i}", short_name=rng.choice([None, f"n{i}"]), csjn_doc_id=rng.choice([None, i])), i))
    log = spark.createDataFrame(writes, CITATIONS.simpleString()[7:-1].replace(":", " ") + ", at int")
    said = spark.createDataFrame(notes, RULINGS.simpleString()[7:-1].replace(":", " ") + ", at int")
    part = lambda df, a, b: df.where(f"at >= {a} AND at < {b}")
    store = GraphStore.create(spark, f"{tmp_path}/g", part(said, 0, 400), part(log, 0, 400), order=["at"], rows=40)
    for a, b, share in ((400, 410, None), (410, 420, 0.9), (420, 1000, 0.2), (1000, 1500, None)):
        store = store.merge(rulings=part(said, a, b), citations=part(log, a, b), order=["at"], share=share)
    assert rows(store.citations) == rows(fold_citations(log, ["at"]).select(*CITATIONS.fieldNames()))
    assert rows(store.table("citing")) == rows(store.citations)
    assert rows(store.rulings) == rows(fold_rulings(said, ["at"]).select(*RULINGS.fieldNames()))
    assert rows(store.compact().rulings) == rows(store.rulings)


def test_two_writers(spark, built):
    one = frames(spark, [], [edge(1, 2, "by one")])[1]
    first = built.merge(citations=one, meta={"crawled": "330,331"})
    with pytest.raises(CommitConflict):
        built.merge(citations=one)
    assert GraphStore(spark, built.folder).version == first.version == 1 and first.meta == {"crawled": "330,331"}
    assert first.citations.where("quote = 'by one'").count() == 1


def test_vacuum_keeps_what_is_named(spark, built):
    merged = built.merge(citations=frames(spark, [], [edge(1, 2, "x")])[1]).compact()
    want = rows(merged.citations)
    assert merged.vacuum(keep=1) > 0
    assert rows(GraphStore(spark, built.folder).citations) == want and GraphStore(spark, built.folder).version == 2
    with pytest.raises(GraphUnavailable):
        GraphStore(spark, built.folder, 0)


def test_empty_and_missing(spark, tmp_path, monkeypatch):
    with pytest.raises(GraphUnavailable, match="build one"):
        GraphStore(spark, f"{tmp_path}/nothing")
    empty = GraphStore.create(spark, f"{tmp_path}/none", *frames(spark, [], []))
    assert empty.citations.isEmpty() and empty.lookup("citations", "a").isEmpty() and empty.rulings.schema.names == RULINGS.names
    filled = empty.merge(citations=frames(spark, [], [edge(1, 2, "x")])[1])
    assert filled.citations.count() == 1
    with pytest.raises(ValueError, match="quote"):
        empty.merge(citations=spark.createDataFrame([("a", "b")], "citing_id string, cited_id string"))
    monkeypatch.setenv("PRUDENTIA_GRAPH_DIR", f"{tmp_path}/none")
    assert GraphStore(spark).version == 1
    spark.conf.set("spark.prudentia.graph.dir", f"{tmp_path}/other")
    try:
        assert stores.graph_dir(spark) == f"{tmp_path}/other"
    finally:
        spark.conf.unset("spark.prudentia.graph.dir")


def test_questions_to_a_stored_graph(spark, made, built):
    nodes, edges, aliases = frames(spark, *made, [(f"NAME {k}", name(k), "caption", "csjn") for k in range(1, 401)])
    plain, kept = CitationGraph(nodes, edges, aliases), StoredGraph(built)
    for asked in (name(7), name(123)):
        assert kept.lookup(asked) == plain.lookup(asked)
        assert kept.citing(asked, limit=5) == plain.citing(asked, limit=5) and kept.cited(asked) == plain.cited(asked)
        a, b = kept.status(asked), plain.status(asked)
        assert a.pop("corpus") == b.pop("corpus") | {"commit": 0} and a == b


@pytest.mark.parametrize("bounds", [[], ["m"], ["a", "b", "b2", "é", "z"]])
def test_range_of_is_bisection(spark, bounds):
    keys = ["", "a", "aa", "b", "b1", "b2", "b3", "m", "y", "z", "zz", "é", "ü"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", stores.range_of(F.col("k"), sorted(bounds)).alias("r")).collect()
    assert {r.k: r.r for r in got} == {k: stores.bisect_right(sorted(bounds), k) for k in keys}
