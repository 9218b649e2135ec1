"""What the fourth round's findings found, on tables small enough to see it."""

import random

from pyspark.sql import functions as F

from prudentia.operators import resolve
from prudentia.operators.upserts import fold_citations, fold_rulings
from prudentia.schema import CITATIONS, RULINGS
from prudentia.sources.shared import Folder
from prudentia.sources.store import TABLES, GraphStore


def test_growing_tables_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    """files of alike rows look small; the driver held all captions and queries."""
    spark.range(0, 30_000, 1, 2).selectExpr("concat('fallos:300:', id) id", "concat('anillo perno', id % 4) caption").write.parquet(f"{tmp_path}/r")
    spark.range(0, 30_000, 1, 2).selectExpr("id query", "concat('perno', id % 3) raw").write.parquet(f"{tmp_path}/q")
    rulings, asked = spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/q")
    found = resolve.suggest_captions(asked, "raw", rulings)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("SortMergeJoin") >= 5 and "BroadcastHashJoin" not in plan
    assert plan.count("BroadcastExchange") == 1  # the number of captions and their mean size
    first = sorted(f"fallos:300:{i}" for i in range(30_000))[:5]
    want = {(q, i + 1, x) for q in (0, 1, 2) for i, x in enumerate(first)}
    assert {(r.query, r.place, r.id) for r in found.where("query < 3").collect()} == want


def test_a_common_beginning_of_captions_is_scored_in_parts(spark, monkeypatch):
    """the parts that a beginning's captions are dealt to change no answer, and of
    equal captions the first ids are found."""
    rulings = spark.createDataFrame([(f"fallos:300:{i:03}", f"perno {'grande ' * (i % 3)}{i % 90}x") for i in range(270)] + [("a", None), ("b", " ")], "id string, caption string")
    asked = spark.createDataFrame([(1, "perno"), (2, "perno grande"), (3, "grande"), (4, "nada"), (5, "de")], "query long, raw string")
    once = {tuple(r) for r in resolve.suggest_captions(asked, "raw", rulings, 7).collect()}
    monkeypatch.setattr(resolve, "CLASSES", 10)
    assert {tuple(r) for r in resolve.suggest_captions(asked, "raw", rulings, 7).collect()} == once
    assert {(q, p) for q, p, *_ in once} == {(q, p) for q in (1, 2, 3) for p in range(1, 8)}
    assert [i for q, p, i, _ in sorted(once) if q == 3][:4] == ["fallos:300:002", "fallos:300:005", "fallos:300:008", "fallos:300:011"]


def test_a_stored_write_deals_and_sorts_once(spark):
    """a table of one range was dealt twice, and every fold sorted anew."""
    log = spark.createDataFrame([], CITATIONS).withColumn("seq", F.lit(0))
    for name in ("citations", "citing"):
        table = TABLES[name]
        for of, rows in (((), log), (("range",), log.withColumn("range", F.length(table.key)))):
            made = table.fold(rows.repartitionByRange(*of, *table.sort), ["seq"], of).sortWithinPartitions(*of, *table.sort)
            plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
            assert plan.count("Exchange ") == 1 and plan.count(" Sort [") == 1


def test_a_batch_that_makes_ranges_due_is_written_once(spark, tmp_path):
    """such a batch was written as a log first, then read and dealt again;
    what is stored stays the fold of all writes in their order."""
    rng, writes, notes = random.Random(6), [], []
    for i in range(900):
        a, b = rng.sample(range(30), 2)
        writes.append((f"r{a}", f"r{b}", rng.choice(["followed", "limited"]), "majority", 0.5, f"q{rng.randint(1, 3)}", "rule", rng.choice([None, i]), i))
        notes.append((f"r{a}", 300, a, f"c{i}", rng.choice([None, f"n{i}"]), None, 1990, "u", "ocr", None, rng.choice([None, i]), i))
    names = lambda schema: schema.simpleString()[7:-1].replace(":", " ") + ", at int"
    log, said = spark.createDataFrame(writes, names(CITATIONS)), spark.createDataFrame(notes, names(RULINGS))
    part = lambda df, a, b: df.where(f"at >= {a} AND at < {b}")
    for first, bounded in ((0, False), (300, True)):
        store = GraphStore.create(spark, f"{tmp_path}/{first}", part(said, 0, first), part(log, 0, first), order=["at"], rows=60)
        assert bool(store.manifest["tables"]["citing"]["bounds"]) == bounded
        for a, b, share in ((first, 310, 0.01 if bounded else 0.2), (310, 316, 0.9), (316, 700, 0.2), (700, 900, 5.0)):
            before = {k: set(Folder(spark, f"{store.folder}/{k}").names()) for k in ("rulings", "citing")}
            store = store.merge(rulings=part(said, a, b), citations=part(log, a, b), order=["at"], share=share)
            if b != 310 or not bounded:  # all ranges go one way
                assert all(len(set(Folder(spark, f"{store.folder}/{k}").names()) - before[k]) == 1 for k in before)
            assert any(p["log"] for p in store.manifest["tables"]["citing"]["ranges"]) == (share > 0.5)
        want = fold_citations(log, ["at"]).select(*CITATIONS.fieldNames())
        for kept in (store, store.compact()):
            assert sorted(map(str, kept.citations.collect())) == sorted(map(str, kept.table("citing").collect())) == sorted(map(str, want.collect()))
            assert sorted(map(str, kept.rulings.collect())) == sorted(map(str, fold_rulings(said, ["at"]).select(*RULINGS.fieldNames()).collect()))
