"""Passages read by a model under one budget, mining before citations, and the
matcher that keeps passages from Python."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prudentia.functions import treatment
from prudentia.functions.spans import citations_in
from prudentia.operators import mining
from prudentia.operators.model_reading import ModelReader, digest_of, first_by_digest, questions
from prudentia.plans import text_queries

FOLDER = "/root/testdata/sf0.001"


def edges(spark, n, per=1):
    rows = [(f"fallos:9:{i}", f"fallos:300:{i // per + 1}", f"Que la doctrina número {i // per} rige, Fallos: 300:{i // per + 1}, en autos.") for i in range(n)]
    return spark.createDataFrame(rows, "citing_id string, cited_id string, quote string")


def model(quote, cited):
    page = int(cited.split(":")[2])
    if page % 10 == 0:
        raise ConnectionError("down")
    return {"treatment": "followed", "confidence": 0.95, "evidence": "la  DOCTRINA número" if page % 4 else "nunca dicho", "cost": 0.01 * (1 + page % 3)}


def read_digests(reader):
    return {r.digest for r in reader.answers().collect()}


@pytest.mark.parametrize("limit", [0.0, 0.1, 1.5, 100.0])
def test_one_budget_whatever_the_partitions(spark, tmp_path, limit):
    asked = edges(spark, 150)
    seen, costs = [], []
    for k, tasks in ((1, 1), (7, 5), (40, 3)):
        reader = ModelReader(spark, f"{tmp_path}/{k}", model)
        spent = reader.read(asked.repartition(k), limit, tasks=tasks)
        seen.append(read_digests(reader))
        costs.append(round(spent.cost, 6))
        assert spent.calls == len(seen[-1]) and spent.left == 150 - spent.calls
    assert seen[0] == seen[1] == seen[2] and len(set(costs)) == 1
    # The digests come first in their order, and the mean of a probe of 16 bounds the overrun.
    order = sorted(r[0] for r in asked.select(digest_of(F.col("quote"), F.col("cited_id"))).collect())
    assert sorted(seen[0]) == order[: len(seen[0])]
    assert (limit == 0) == (not seen[0]) and costs[0] <= limit + 0.48
    assert limit < 100 or len(seen[0]) == 150


def test_a_rerun_asks_only_what_is_new(spark, tmp_path):
    asked = edges(spark, 60, per=2)
    reader = ModelReader(spark, f"{tmp_path}/r", model)
    assert reader.read(asked, 100, most=10).calls == 10
    first = read_digests(reader)
    assert reader.read(asked, 100).calls == 30  # 60 edges pose 30 questions
    assert first < read_digests(reader)
    again = ModelReader(spark, f"{tmp_path}/r", lambda q, c: pytest.fail("asked again"))
    assert again.read(asked, 100).calls == 30
    readings = again.readings(asked).collect()
    refused = {p for p in range(1, 31) if p % 4 == 0 and p % 10}
    failed = {p for p in range(1, 31) if p % 10 == 0}
    assert {int(r.cited_id.split(":")[2]) for r in readings} == set(range(1, 31)) - refused - failed
    assert len(readings) == 2 * (30 - len(refused | failed)) and {(r.confidence, r.method) for r in readings} == {(0.7, "llm")}
    report = again.report(asked).first()
    cost = sum(0.01 * (1 + p % 3) for p in range(1, 31) if p % 10)
    assert (report.calls, report.failed, report.refused) == (30, len(failed), len(refused)) and abs(report.cost - cost) < 1e-9 and abs(report.mean_cost - cost / 30) < 1e-9


def test_what_poses_a_question(spark):
    rows = [("a", "fallos:1:2", "dijo Fallos: 1:2."), ("b", "fallos:1:2", "dijo Fallos: 1:2."), ("c", "fallos:1:2", "REFERENCIA publicada por la CSJN en Fallos: 1:2"), ("d", "fallos:1:2", "dijo Fallos: 11:2."), ("e", "fallos:1:2", "1:2 sin marca"), ("f", "fallos:1:2", None), ("g", None, "Fallos: 1:2"), ("h", "fallos:3:4", "Fallos: 1:2; 3 : 4 y más")]
    found = questions(spark.createDataFrame(rows, "citing_id string, cited_id string, quote string")).collect()
    assert sorted((r.cited_id, r.quote) for r in found) == [("fallos:1:2", "dijo Fallos: 1:2."), ("fallos:3:4", "Fallos: 1:2; 3 : 4 y más")]


def test_first_by_digest(spark):
    rows = [(f"{random.Random(i).getrandbits(32):08x}",) for i in range(500)] + [(f"aaaa{i:04x}",) for i in range(50)]
    frame = spark.createDataFrame(rows, "digest string")
    for n in (0, 1, 30, 333, 549, 550, 1000):
        assert sorted(r[0] for r in first_by_digest(frame, n).collect()) == sorted(r[0] for r in rows)[:n]


def test_windows_before_citations(spark):
    cases = [
        ("fallos:1:2", "Uno; que a juicio de esta Corte CORRESPONDÍA aplicar, en el año 1998, la señalada doctrina de Fallos: 1:2 y otras.", "corte correspondia aplicar en el ano la senalada doctrina de fallos".split()[-8:]),
        ("fallos:1:2", "Antes de eso; Fallos: 1:2", ["fallos"]),
        ("fallos:1:2", "Fallos: 9:9", None),
        ("fallos:1:2", None, None),
    ]
    frame = spark.createDataFrame([(i, c, q) for i, (c, q, _) in enumerate(cases)], "i long, cited string, quote string")
    got = {r.i: r.w for r in frame.select("i", mining.left_window(F.col("quote"), F.col("cited")).alias("w")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def counted(windows, least, top, stems):
    edge, count = set(mining.EDGE_WORDS), Counter()
    for w in windows:
        grams = set()
        for n in range(2, 7):
            for i in range(len(w) - n + 1):
                inner = [j for j in range(i, i + n) if w[j] not in edge]
                if inner and inner[-1] > inner[0]:
                    grams.add(" ".join(w[inner[0] : inner[-1] + 1]))
        count.update(g for g in grams if any(s in g for s in stems))
    return sorted(((g, n) for g, n in count.items() if n >= least), key=lambda x: (-x[1], x[0]))[:top]


def test_mining_query_equals_brute_force(spark):
    windows = []
    for r in text_queries.passages(spark, FOLDER).collect():
        if r.key % 5 == 0 or r.key % 3 == 0:
            continue
        quote, ident = f"Se dijo: algo; {r.quote} Nada más.", r.cited.lower().replace(" ", "")
        start = next(s for _, s, _, v, p in citations_in(quote) if f"fallos:{v}:{p}" == ident)
        clause = treatment.clause_around(quote, start)
        at = clause.find(quote[start : start + 8])
        plain = unicodedata.normalize("NFD", clause[:at].lower())
        windows.append(re.findall("[a-z]+", "".join(c for c in plain if not unicodedata.combining(c)))[-8:])
    want = counted(windows, 2, 60, mining.STEMS)
    assert [tuple(r) for r in text_queries.mined_before_citations(spark, FOLDER).collect()] == want and len(want) > 20


def test_mining_of_odd_passages(spark):
    rows = [(None,), ([],), (["uno"],), (["de", "la"],), (["aplica", "de", "la"],), (["de", "aplica", "la", "norma", "de"],), (["aplica", "la", "norma"],)]
    frame = spark.createDataFrame(rows, "words array<string>")
    assert [tuple(r) for r in mining.mine(frame, "words", 2, 10).collect()] == [("aplica la norma", 2)]
    assert mining.mine(frame, "words", 3, 10).isEmpty()
    assert [tuple(r) for r in mining.mine(frame, "words", 1, 10, stems=["nor"]).collect()] == [("aplica la norma", 2)]


def test_mining_by_frequent_words_first(spark, monkeypatch):
    """The same phrases whether the first words do, more are let in, or all."""
    rng = random.Random(6)
    texts = [[rng.choice("abcdefgh") * rng.choice([1, 1, 1, 2]) if rng.random() < 0.8 else f"rare{rng.randrange(60)}" for _ in range(rng.randint(0, 30))] for _ in range(120)]
    frame = spark.createDataFrame([(t,) for t in texts], "words array<string>")
    want = counted(texts, 2, 25, [""])
    for vocabulary in ((6, 30), (3, 5), (1000, 2000), (12, 13)):
        monkeypatch.setattr(mining, "VOCABULARY", vocabulary)
        assert [tuple(r) for r in mining.mine(frame, "words", 2, 25, stems=[""]).collect()] == want


def test_only_readable_passages_reach_python(spark):
    """The matcher lets no passage by that a rule reads, whole or in its clause."""
    rng = random.Random(8)
    pieces = [t[0] % "Fallos: 1:2" for t in text_queries._TEMPLATES] + [
        "doctrina de la arbitrariedad", "la doctrina del", "no comparte esta Corte. esa conclusión", "En Igual Sentido", "según lo estableció la Corte", "corresponde apartarse", "NO RESULTA APLICABLE AL CASO", "a diferencia de", "nada", "; y en", ".", "sólo es aplicable", "al citado precedente",
    ]
    quotes = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(400)] + ["x " * 120 + "doctrina delegada " + "y " * 130 + "Fallos: 1:2", "", None]
    rows = [(i, q, rng.choice([None, rng.randrange(len(q))]) if q else None) for i, q in enumerate(quotes)]
    frame = spark.createDataFrame(rows, "i long, quote string, position int")
    got = {r.i: tuple(r.r) for r in treatment.read_passages(frame, "quote", F.col("position")).collect()}
    assert got == {i: tuple(treatment.read_passage(q, p)) for i, q, p in rows}
    plain = spark.createDataFrame([(f"Que en el expediente número {i} se resolvió el pedido de la parte, Fallos: 1:{i + 1}.",) for i in range(50)], "quote string")
    assert plain.where(treatment.may_be_read(F.col("quote"))).count() == 0
