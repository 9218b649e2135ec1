"""Single operators on hand-written cases."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prudentia.api import CitationGraph, NotFound, Page, parse_treatment, trimmed
from prudentia.functions import spans, text
from prudentia.functions.treatment import read_passage
from prudentia.operators import batches, mining, resolve, signals, trace, upserts
from prudentia.plans import text_queries

A, B, C, D = "fallos:300:254", "fallos:308:1392", "fallos:313:1333", "fallos:332:1963"


@pytest.fixture(scope="module")
def golden(spark):
    """Four rulings, five readings: one doctrine left, taken up and left."""
    rulings = spark.createDataFrame([(i, int(i.split(":")[1]), int(i.split(":")[2]), n, y, "ocr") for i, n, y in ((A, "COLAVINI", 1978), (B, "BAZTERRICA", 1986), (C, "MONTALVO", 1990), (D, "ARRIOLA", 2009))], "id string, volume int, page int, caption string, decided_year int, text_status string")
    edges = [(D, B, "followed"), (D, C, "abandoned"), (D, A, "mentioned"), (B, A, "mentioned"), (C, B, "abandoned")]
    citations = spark.createDataFrame([(a, b, t, "majority", 1.0, f"{a} on {b}", "manual", None) for a, b, t in edges], "citing_id string, cited_id string, treatment string, opinion string, confidence double, quote string, method string, sumario_id long")
    aliases = spark.createDataFrame([("ARRIOLA", D, "short_name", "manual"), ("A.891.XLIV", D, "expediente", "csjn")], "raw string, ruling_id string, form string, source string")
    return rulings, citations, aliases


def test_golden_signals(golden):
    rows = {r.id: r for r in signals.caveats(signals.signals(*golden[:2])).collect()}
    assert rows[C].signal == "red" and rows[B].signal == "yellow" and rows[B].restored
    assert rows[A].signal == "gray" and rows[A].confidence <= 0.5
    assert rows[D].signal == "gray" and rows[D].confidence == 0.0 and rows[D].total_citing == 0
    assert any("Fallos: 332:1963 (2009)" in c for c in rows[B].caveats)


@pytest.mark.parametrize(
    ("records", "expected"),
    [
        ([("abandoned", "majority", 0.75, 2000)], "red"),
        ([("abandoned", "majority", 0.74, 2000)], "gray"),
        ([("abandoned", "dissent", 1.0, 2000), ("followed", "majority", 0.1, 1990)], "green"),
        ([("abandoned", "majority", 0.9, 2000), ("followed", "majority", 0.9, 2001)], "yellow"),
        ([("abandoned", "majority", 0.9, 2000), ("followed", "majority", 0.9, 2000)], "red"),
        ([("abandoned", "majority", 0.9, 0), ("followed", "majority", 0.9, 2010)], "red"),
        ([("abandoned", "majority", 0.9, 2000), ("followed", "dissent", 0.9, 2010)], "red"),
        ([("criticized", "majority", 0.1, 2000), ("applied", "majority", 0.9, 2001)], "yellow"),
        ([("mentioned", "majority", 0.9, 2000)], "gray"),
    ],
)
def test_signal_rules(spark, records, expected):
    nodes = [("fallos:1:1", 1900)] + [(f"fallos:2:{i + 1}", y) for i, (*_, y) in enumerate(records)]
    rulings = spark.createDataFrame(nodes, "id string, decided_year int")
    edges = [(f"fallos:2:{i + 1}", "fallos:1:1", t, o, c, "q", "rule") for i, (t, o, c, _) in enumerate(records)]
    citations = spark.createDataFrame(edges, "citing_id string, cited_id string, treatment string, opinion string, confidence double, quote string, method string")
    assert signals.signals(rulings, citations).where("id = 'fallos:1:1'").first().signal == expected


def test_trace(golden):
    steps = trace.trace_steps(golden[1], golden[0], B, 3)
    assert {(r.from_id, r.to_id, r.treatment) for r in steps.collect()} == {(B, C, "abandoned"), (B, D, "followed"), (C, D, "abandoned")}


def test_api(golden):
    graph = CitationGraph(*golden)
    assert graph.lookup("332:1963")["aliases"] == ["A.891.XLIV", "ARRIOLA"]
    assert graph.lookup(' "Arriola" ')["id"] == D
    assert graph.lookup("A. 891. XLIV. RHE")["id"] == D
    assert graph.status("Fallos: 313:1333")["signal"] == "red"
    assert graph.citing("308:1392", "followed")["total"] == 1
    assert [r["id"] for r in graph.cited(D, limit=2)["items"]] == [A, B]
    assert graph.trace(B)["omitted"] == 0
    with pytest.raises(NotFound, match="308:1392"):
        graph.lookup("Fallos 308:1932")
    for bad in ("", "  ", "x" * 301):
        with pytest.raises(ValueError):
            graph.lookup(bad)
    with pytest.raises(ValueError):
        parse_treatment("nada")


def test_page_past_the_end():
    assert Page(5, 10, []).as_dict()["has_more"] is False
    assert Page(5, 0, [{}]).as_dict()["next_offset"] == 1


def test_dense_graph_is_capped(spark):
    nodes = spark.createDataFrame([(f"fallos:300:{i}", 300, i, "c", 1980 + i % 40, "ocr") for i in range(1, 61)], "id string, volume int, page int, caption string, decided_year int, text_status string")
    edges = [(f"fallos:300:{j}", f"fallos:300:{i}", "followed", "majority", 0.9, "q", "rule") for i in range(1, 61) for j in range(i + 1, min(i + 11, 61))]
    citations = spark.createDataFrame(edges, "citing_id string, cited_id string, treatment string, opinion string, confidence double, quote string, method string")
    graph = CitationGraph(nodes, citations, spark.createDataFrame([], "raw string, ruling_id string, form string, source string"))
    answer = graph.trace("fallos:300:1", 99)
    assert len(answer["steps"]) == 40 and answer["omitted"] > 0


def column(spark, f, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(f(F.col("x"))).collect()]


def test_scalars(spark):
    assert column(spark, text.parse_ruling_id, "Fallos: 332:1963", "332:1963", " fallos 1 : 9 ", "501:1", "3:0", "see 3:4", None) == ["fallos:332:1963", "fallos:332:1963", "fallos:1:9", None, None, None, None]
    assert column(spark, text.normalize_docket, "A. 891. XLIV. RHE", "A.891.XLIV", "CSJ 001086/2022/CS001", "CCC.", "", "algo") == ["A.891.XLIV", "A.891.XLIV", "CSJ.1086/2022/CS001", None, None, None]
    assert column(spark, text.normalize_caption, "ARRIOLA SEBASTIAN Y OTROS s/CAUSA N 9080", "Arriola, Sebastián y otros s/ causa n° 9080.") == ["ARRIOLA SEBASTIAN"] * 2
    assert column(spark, text.short_name_key, '"Arriola"', "“Ñandú” ") == ["ARRIOLA", "NANDU"]
    assert column(spark, text.clean_text, "a￾b  c \r\n\r\n\r\n\r\nd\t \n") == ["ab c\n\nd"]
    assert column(spark, text.join_page_breaks, "pala-//-pie\n12-//-bra -7- fin -//-x") == ["palabra fin x"]
    assert column(spark, text.text_status, "esta frase es clara", "1 2 3 xx zz", " \n", None) == ["extracted", "garbled", "unavailable", "unavailable"]
    assert column(spark, text.strip_html, "<p>a<b>b</b>\n c</p>", None, "") == ["a b c", "", ""]
    assert column(spark, text.parse_citing, "<a>Fallos: 347:1031</a><a> Fallos: 999:1 </a><a>Fallos: 347:1031</a>", None) == [["fallos:347:1031"], []]
    assert column(spark, text.render_quote, "a `b`\n> c") == ["> a 'b' › c"]
    assert column(spark, text.fold, "Año 1998: DOCTRINA señalada") == ["ano doctrina senalada"]


def test_citations_and_opinions():
    found = lambda t: [(c[3], c[4]) for c in spans.citations_in(t)]
    assert found("en Fallos: 308:1392; 310:294 y 313:1333, 1335") == [(308, 1392), (310, 294), (313, 1333)]
    assert found("Fallos: 181:209, 213/214; 239:80") == [(181, 209)]
    assert found("ver 308:1392 y Fallos 501:3, 7:9") == [(7, 9)]
    body = "Considerando: Fallos: 1:2. DISIDENCIA DEL SEÑOR MINISTRO DOCTOR DON JUAN PEREZ Considerando: Fallos: 3:4."
    kinds = list(spans.turns(body))
    assert [k[1:] for k in kinds] == [("dissent", "JUAN PEREZ")] and kinds[0][0] == body.index("DISIDENCIA")
    assert [(c[0], o, a) for c, o, a in spans.attributed(body)] == [("1:2", "majority", ""), ("3:4", "dissent", "JUAN PEREZ")]
    assert [k[1] for k in spans.turns("DICTAMEN DEL PROCURADOR GENERAL x FALLO DE LA CORTE SUPREMA y")] == ["dictamen", "majority"]
    # A heading inside another: the court's turn within the vote's names counts, the same kind's doesn't.
    nested = "VOTO DEL SEÑOR MINISTRO A VOTO DEL SEÑOR MINISTRO B FALLO DE LA CORTE SUPREMA Considerando: Fallos: 1:2"
    assert [k[:2] for k in spans.turns(nested)] == [(0, "concurrence"), (nested.index("FALLO"), "majority")]
    assert [o for _, o, _ in spans.attributed(nested)] == ["majority"]
    many = "Disidencia parcial de la señora ministra doctora doña Ana Paz Considerando Fallos: 5:6; VOTO DE LOS SEÑORES MINISTROS DOCTORES DON X Y DON Z Considerando Fallos: 7:8."
    assert [(c[3], o, a) for c, o, a in spans.attributed(many)] == [(5, "partial_dissent", "Ana Paz"), (7, "concurrence", "X Y DON Z")]


@pytest.mark.parametrize(
    ("quote", "position", "treatment", "rule"),
    [
        ("Que corresponde apartarse de la doctrina de Fallos: 1:2.", 42, "abandoned", "apartarse-de-la-doctrina"),
        ("No corresponde apartarse de la doctrina sentada en Fallos: 1:2.", 52, "mentioned", None),
        ("Se refiere a Fallos: 1:2; y luego corresponde apartarse de otra cosa.", 13, "mentioned", None),
        ("Se refiere a Fallos: 1:2; y cabe remitirse a lo resuelto en otra.", 13, "followed", "remision-a-lo-resuelto"),
        ("El apelante invoca la doctrina de Fallos: 1:2.", 34, "mentioned", "doctrina-de(atribuido)"),
        ('En "Bazterrica" se aparto de tal doctrina de Fallos: 1:2.', 45, "mentioned", "se-aparto-de-tal-doctrina(relato-historico)"),
        ("", None, "mentioned", None),
    ],
)
def test_readings(quote, position, treatment, rule):
    got = read_passage(quote, position)
    assert (got.treatment, got.rule) == (treatment, rule)


def test_model_is_asked_last():
    from prudentia.functions.treatment import Reading

    asked = []
    model = lambda q: asked.append(q) or Reading("followed", 0.6, "model", "llm")
    assert read_passage("nada que ver", None, model).treatment == "followed"
    assert read_passage("obliga la doctrina", None, model).treatment == "applied" and len(asked) == 1


def test_typo_pages(spark):
    rows = spark.createDataFrame([(1932,), (7,)], "p int").select(resolve.typo_pages(F.col("p"))).collect()
    assert rows[0][0][:3] == [9132, 1392, 1923] and len(set(rows[0][0])) == len(rows[0][0]) == 39
    assert rows[1][0] == [1, 2, 3, 4, 5, 6, 8, 9]


def test_upserts(spark):
    log = spark.createDataFrame(
        [("fallos:1:2", 1, 2, "old", 1990, "u", "ocr", 0.9, "Name", None, 5, 1), ("fallos:1:2", 1, 2, "new", 0, "u", "unavailable", None, None, "01/02/1990", None, 2)],
        "id string, volume int, page int, caption string, decided_year int, source_url string, text_status string, text_quality double, short_name string, decided_on string, csjn_doc_id long, seq int",
    )
    row = upserts.fold_rulings(log, ["seq"]).first()
    assert (row.caption, row.decided_year, row.text_status, row.text_quality) == ("new", 0, "unavailable", None)
    assert (row.short_name, row.decided_on, row.csjn_doc_id) == ("Name", "01/02/1990", 5)
    aliases = spark.createDataFrame([(" ", "x", "fallos", "csjn", 1), ("A", "x", "fallos", "csjn", 1), ("A", "y", "caption", "manual", 2)], "raw string, ruling_id string, form string, source string, seq int")
    assert [tuple(r) for r in upserts.fold_aliases(aliases, ["seq"]).collect()] == [("A", "y", "fallos", "csjn")]
    one = spark.range(1)
    assert one.select(upserts.add_source(F.lit("a + b"), F.lit("a")), upserts.mark_done(F.lit("331,9"), F.lit(10))).first()[:] == ("a + b", "9,10,331")


def test_streaming_is_idempotent(spark, tmp_path):
    from prudentia.streaming.ingest import folded, ingest

    (tmp_path / "in").mkdir()
    record = {"id": 1, "tomo": 308, "pagina": 1392, "caratulaWeb": "A", "fechaString": "1986", "linksCitantes": "<a> Fallos: 332:1963 </a><a> Fallos: 308:1392 </a>"}
    for name, caption in (("a", "A"), ("b", "B")):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(record | {"caratulaWeb": caption}) + "\n" + json.dumps({"id": 2, "tomo": 999, "pagina": 1}))
        stream = spark.readStream.format("text").load(f"{tmp_path}/in")
        ingest(stream, "value", f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    rulings, citations = folded(spark, f"{tmp_path}/log")
    assert {(r.id, r.caption) for r in rulings.collect()} == {("fallos:308:1392", "B"), ("fallos:332:1963", "Fallos: 332:1963")}
    assert citations.count() == 1


def test_every_part_is_asked(spark):
    folder = "/root/testdata/sf0.001"
    parts = {r.p_partkey for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey").collect()}
    pages = {}
    for r in text_queries.rulings(spark, folder).select("id", "volume", "page").collect():
        pages.setdefault(r.volume, []).append((r.page, r.id))
    asked = {(k, 300 + k % 50, k % 60 + 1) for k in parts}
    nearest, slips = set(), set()
    for k, volume, page in asked:
        best = sorted(pages.get(volume, []), key=lambda x: (abs(x[0] - page), x[0]))[:5]
        nearest |= {(k, i + 1, x[1]) for i, x in enumerate(best)}
        d = str(page)
        tried = {int(d[:i] + d[i + 1] + d[i] + d[i + 2 :]) for i in range(len(d) - 1)} | {int(d[:i] + c + d[i + 1 :]) for i in range(len(d)) for c in "0123456789"}
        slips |= {(k, x) for p, x in pages.get(volume, []) if p in tried - {page}}
    got = text_queries.suggest_nearest_all(spark, folder).collect()
    assert {tuple(r) for r in got} == nearest and len(got) == len(nearest)
    assert {tuple(r) for r in text_queries.suggest_typo_all(spark, folder).collect()} == slips
    assert {r.query for r in text_queries.suggest(spark, folder).collect()} >= {k for k, *_ in nearest}
    some = {tuple(r) for r in text_queries.fts_prefix_bm25(spark, folder).collect()}
    every = {tuple(r) for r in text_queries.fts_prefix_bm25_all(spark, folder).collect()}
    assert some <= every and {q for q, *_ in every} == parts


def test_whole_texts_are_mined_and_joined(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    edge, count = set(mining.EDGE_WORDS), Counter()
    for body in texts.values():
        w = re.findall(r"[^\W\d_]+", body.lower())
        grams = set()
        for n in range(2, 7):
            for i in range(len(w) - n + 1):
                inner = [j for j in range(i, i + n) if w[j] not in edge]
                if inner and inner[-1] > inner[0]:
                    grams.add(" ".join(w[inner[0] : inner[-1] + 1]))
        count.update(grams)
    best = sorted(((g, n) for g, n in count.items() if n >= 2), key=lambda x: (-x[1], x[0]))[:50]
    assert [tuple(r) for r in text_queries.ngram_mining_all(spark, folder).collect()] == best
    made = {r.doc_id: r.joined for r in text_queries.page_breaks_all(spark, folder).collect()}
    assert any(len(t) > 2000 for t in texts.values())
    for d, t in texts.items():
        put = re.sub(r"(?s)(.{300})(.{1,500})", r"\1\2 ", t)  # only the page numbers leave a blank
        assert made[d] == re.sub(r"[ \t]{2,}", " ", put)


def test_trace_names_all_signals_and_trims(golden):
    graph = CitationGraph(*golden)
    lights = {r.id: r.signal for r in graph.trace_signals(B).collect()}
    every = {r.id: r.signal for r in signals.signals(*golden[:2]).collect()}
    assert lights == {i: every[i] for i in (B, C, D)}
    assert trimmed("a  b") == "a b" and trimmed("x" * 321) == "x" * 320 + "… [pasaje recortado]"
    assert graph.status(A)["corpus"]["rulings"] == 4 and graph.status(A)["nonbinding_by_opinion"] == {}


def test_batch_arguments(spark):
    assert list(batches.parse_volumes("330-332")) == [330, 331, 332] and list(batches.parse_volumes("5")) == [5]
    assert batches.parse_ruling("332:1963") == (332, 1963)
    with pytest.raises(ValueError):
        batches.parse_ruling("332")
    found = column(spark, batches.crawled_range, "332, 330,x,,340", "", "no", None)
    assert [r and tuple(r) for r in found] == [(330, 340), None, None, None]
    assert column(spark, batches.status_label, "ocr", "new") == ["recuperado por OCR", "new"]


def test_ingest_isolates_and_resumes(spark):
    good = "Que la doctrina del precedente rige en este caso por las razones dadas. Fallos: 301:2. "
    docs = spark.createDataFrame([("a", good), ("a", good), ("b", None), ("c", " \n"), ("d", "q7 8%% zz9 1x " * 20 + "Fallos: 301:2."), ("e", good), ("f", "Sin citas, pero con palabras claras.")], "id string, text string")
    report, edges = batches.ingest(docs, spark.createDataFrame([("e",)], "id string"))
    rows = {r.id: (r.text_status, r.n_edges, r.error) for r in report.collect()}
    assert rows == {"a": ("extracted", 1, None), "b": ("unavailable", 0, "no text"), "c": ("unavailable", 0, "no text"), "d": ("garbled", 0, "text below the quality floor"), "f": ("extracted", 0, None)}
    assert [(r.citing_id, r.cited_id) for r in edges.collect()] == [("a", "fallos:301:2")]
    none, no_edges = batches.ingest(docs.limit(0))
    assert none.count() == 0 and no_edges.count() == 0


def test_traces_of_many_starts(spark, golden):
    starts = spark.createDataFrame([(B,), (A,), (B,), ("fallos:9:9",), (None,)], "id string")
    got = {(r.start, r.from_id, r.to_id, r.depth) for r in trace.traces(golden[1], golden[0], starts, 3).collect()}
    want = {(s, r.from_id, r.to_id, r.depth) for s in (A, B) for r in trace.trace_steps(golden[1], golden[0], s, 3).collect()}
    assert got == want and want
    lights = {(r.start, r.id): (r.depth, r.signal) for r in trace.reached_signals(golden[1], golden[0], starts).collect()}
    assert lights[B, B] == (0, "yellow") and lights[B, C] == (1, "red") and lights[B, D] == (1, "gray") and lights["fallos:9:9", "fallos:9:9"] == (0, None)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("prudentia_")]


def test_a_level_shuffles_what_it_finds_and_nothing_else(spark):
    edges = spark.range(3000).select(F.concat(F.lit("c"), (F.col("id") % 200).cast("string")).alias("cited_id"), F.concat(F.lit("c"), (F.col("id") * 7 % 211).cast("string")).alias("citing_id"))
    dealt = trace._Dealt(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with trace._by_part_of_the_key(spark):
            pairs = dealt.put(edges.distinct().repartition(dealt.parts, "cited_id"), "cited_id")
            one = dealt.put(edges.select(F.col("cited_id").alias("start"), F.col("cited_id").alias("id")).distinct().repartition(dealt.parts, "id"), "id")
            two = dealt.put(trace.next_level(pairs, one, [one], dealt.parts), "id")
            plan = trace.next_level(pairs, two, [one, two], dealt.parts)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        dealt.forget()


def test_constraints_between_rows(spark):
    rows = [("a", "b", "q", 2), ("a", "b", "q", 1), ("a", "b", "q", 3), ("a", "b", " ", 0), ("a", "x", "q", 4), ("x", "b", "q", 5), (None, "b", "q", 6), ("b", "a", "q", 7), ("b", "a", "r", 8), ("b", "a", "r", 8), ("a", "b", None, 9)]
    edges = spark.createDataFrame(rows, "citing_id string, cited_id string, quote string, seq int").withColumns({"confidence": F.lit(0.5), "treatment": F.lit("followed"), "opinion": F.lit("majority"), "method": F.lit("rule")})
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    key, ends = ["citing_id", "cited_id", "quote"], {"citing_id": "no citing", "cited_id": "no cited"}
    got = sorted((r.seq, r.reason) for r in upserts.checked_load(upserts.checked_citations(edges), key, ["seq"], edges.where("seq = 7"), ends, known).collect())
    assert got == [(0, "blank quote"), (1, "accepted"), (2, "repeated in the load"), (3, "repeated in the load"), (4, "no cited"), (5, "no citing"), (6, "cites itself"), (7, "stored before"), (8, "accepted"), (8, "accepted"), (9, "blank quote")]
    none = upserts.checked_load(upserts.checked_citations(edges.where("false")), key, ["seq"], edges, ends, known)
    assert none.isEmpty() and none.columns == [*edges.columns, "reason"]
    aliases = upserts.checked_aliases(spark.createDataFrame([("N", "a", "caption", 1), ("N", "b", "caption", 2), ("M", "z", "caption", 3)], "raw string, ruling_id string, form string, seq int"))
    assert sorted((r.seq, r.reason) for r in upserts.checked_load(aliases, ["raw"], ["seq"], None, {"ruling_id": "no ruling"}, known).collect()) == [(1, "accepted"), (2, "repeated in the load"), (3, "no ruling")]
