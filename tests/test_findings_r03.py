"""What the third round's findings found, on tables small enough to see it."""

import re

from pyspark.sql import functions as F

from prudentia.functions import spans
from prudentia.functions.text import join_page_breaks, text_quality
from prudentia.functions.treatment import RULES, STEMS
from prudentia.operators.batches import ingest
from prudentia.operators.resolve import resolve
from prudentia.operators.upserts import checked_rulings
from prudentia.plans import text_queries
from prudentia.plans.evaluation_queries import WORDINGS
from prudentia.schema import ANY_PAGE
from prudentia.sources.records import parse_records
from prudentia.sources.store import TABLES, range_of
from prudentia.streaming.ingest import record_rulings


def test_resolve_finds_pages_beyond_four_digits(spark):
    rulings = spark.createDataFrame([("fallos:301:12000",), ("fallos:301:9999",)], "id string")
    aliases = spark.createDataFrame([], "raw string, ruling_id string")
    asked = spark.createDataFrame([("Fallos: 301:12000",), ("301:9999",), ("301:12001",)], "raw string")
    assert {r.raw: r.resolved for r in resolve(asked, "raw", rulings, aliases).collect()} == {"Fallos: 301:12000": "fallos:301:12000", "301:9999": "fallos:301:9999", "301:12001": None}


def test_records_of_a_crawl_keep_pages_beyond_four_digits(spark):
    raw = spark.createDataFrame([('{"id": 1, "tomo": 301, "pagina": 12000, "linksCitantes": "<a> Fallos: 302:12001 </a><a> Fallos: 303:7 </a>"}',)], "value string")
    assert not parse_records(raw, "value").collect()
    records = parse_records(raw, "value", (), ANY_PAGE)
    assert [(r.id, r.citing) for r in records.collect()] == [("fallos:301:12000", ["fallos:302:12001", "fallos:303:7"])]
    assert [r.reason for r in checked_rulings(record_rulings(records), ANY_PAGE).collect()] == ["accepted"]


def test_a_citation_is_read_where_it_stands(spark):
    """326:49 is also the beginning of 326:497 before it, in another clause."""
    body = "Que cabe remitirse a lo resuelto en Fallos: 326:497, 86; 326:49. Asi se decide."
    docs = spark.createDataFrame([("fallos:999:1", body)], "id string, text string")
    assert [(r.cited_id, r.confidence) for r in spans.extract_edges(docs).orderBy("offset").collect()] == [("fallos:326:497", 0.85), ("fallos:326:49", 0.552)]
    for blank in ("", " ", "\n \t"):
        quote, place = spans.passage_of(f"  Que  en{blank}Fallos:\n 326:49 rige.", len("  Que  en") + len(blank) + len("Fallos:\n "), len("  Que  en") + len(blank) + len("Fallos:\n 326:49"))
        assert quote.find("326:49") == place


def test_made_texts_are_no_single_tasks(spark):
    for query in (text_queries.quotes, text_queries.find_citations, text_queries.passages):
        assert query(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4


def test_cheap_looks_leave_nothing_out():
    for (*_, pattern), stems, wording in zip(RULES, STEMS, WORDINGS, strict=True):
        for text in (wording, wording.upper(), wording.title()):
            hit = re.search(pattern, text, re.IGNORECASE)
            assert hit and any(stem in hit[0].lower() for stem in stems)
    text = "x voto DE LA señora jueza ELENA considerando dictamen del procurador general fallo de la corte suprema disidencia parcial del señor ministro Z considerando"
    assert [(o, text[p : p + 4]) for p, o, _ in spans.turns(text)] == [("concurrence", "voto"), ("dictamen", "dict"), ("majority", "fall"), ("partial_dissent", "disi")]


def test_a_stored_table_is_folded_where_its_ranges_lie(spark):
    table = TABLES["citing"]
    rows = spark.createDataFrame([("a", "b", "applied", "majority", 0.5, "q", "rule", 1, 0), ("a", "b", "limited", "majority", 0.7, "q", "llm", 2, 1), ("c", "b", "applied", "majority", 0.5, "q", "rule", None, 0)], "citing_id string, cited_id string, treatment string, opinion string, confidence double, quote string, method string, sumario_id long, seq long")
    folded = table.fold(rows.withColumn("range", range_of(F.col(table.key), ["b"])).repartitionByRange("range", *table.sort), ["seq"], ("range",))
    assert sorted((r.citing_id, r.treatment, r.method, r.sumario_id, r.range) for r in folded.collect()) == [("a", "limited", "llm", 1, 0), ("c", "applied", "rule", None, 1)]
    assert folded._jdf.queryExecution().sparkPlan().toString().count("rangepartitioning") == 1
    assert folded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_texts_are_judged_without_a_list_of_their_tokens(spark):
    """F8, F12: tokens are counted where they stand; what is found is what splitting
    finds, and page furniture is what was found before each dash was looked at first."""
    odd = ["", " ", "\n", "a", "ab", "bc", "b.a", ".ab", "casa, «voto» (de)", "x1 casa 12 casa- -casa", "casa voto fin", "casa\u0085voto fin\r\n", "\U0001f600casa casa\U0001f600 \U0001d41a áb", "ÁRBOL ñandú çedilla", "bcd" * 3000 + "a", ("casa " * 500).strip(), None]
    odd += ["a -12- b", "a-12- b", "-1--22- x", "é-3- 4-5-6", " -7- ", "_-8-_", "-//-", "a -//- b -//- c -//- d", "-//-//-x", "-" * 9, "a  \t b", "-12345- -1-2-"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    tokens = F.filter(F.split("t", r"(?U)\s+"), lambda t: t != "")
    letter = "A-Za-zÁÉÍÓÚÑÜáéíóúñü"
    like = F.filter(tokens, lambda t: (F.length(t) >= 2) & t.rlike(f"""^[{letter}][{letter}.,;:()«»"'\\-]*$""") & t.rlike("[aeiouáéíóúAEIOUÁÉÍÓÚ]"))
    split = F.when(F.size(tokens) > 0, F.size(like) / F.size(tokens)).otherwise(F.lit(0.0))
    out = F.regexp_replace(F.regexp_replace("t", r"(?s)-//-.{0,400}?-//-", ""), "-//-", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)(?<!\w)-\d{1,4}-(?!\w)", " "), r"[ \t]{2,}", " ")
    judged = df.select("t", text_quality(F.col("t")).alias("q"), split.alias("expected"), join_page_breaks(F.col("t")).alias("joined"), out.alias("plain"))
    for row in judged.collect():
        assert (row.q, row.joined) == (row.expected, row.plain), row
    plan = judged.select("q")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


def test_a_batch_judges_a_text_once_for_its_report(spark):
    docs = spark.createDataFrame([("fallos:1:1", "la casa es grande"), ("fallos:1:2", "zz 11 zz")], "id string, text string")
    report, _ = ingest(docs)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.text_status) for r in report.collect()) == [("fallos:1:1", "extracted"), ("fallos:1:2", "garbled")]
    assert plan.count("++") == 1  # words are looked for once, for the state and for what may be read
    assert "Join" not in plan


def test_phrases_are_counted_with_one_exchange(spark):
    """a phrase counts once for each passage that holds it, however its tasks cut
    the passages; codes have Spark's own hash, and one exchange is all it takes."""
    import random

    from pyspark.sql import functions as F

    from prudentia.operators import mining

    rng = random.Random(4)
    texts = [[rng.choice(["de", "ba", "bo", "bu", "la", None]) for _ in range(rng.randint(0, 30))] for _ in range(300)] + [None, [], ["ba"], ["ba", "bo"] * 40]
    frame = spark.createDataFrame([(t,) for t in texts], "words array<string>").repartition(3)
    want = {}
    for t in texts:
        t = t or []
        grams = {tuple(t[i : i + k]) for k in range(2, 7) for i in range(len(t) - k + 1)}
        for g in grams:
            if None not in g and g[0] not in mining.EDGE_WORDS and g[-1] not in mining.EDGE_WORDS and "bo" in g:
                want[g] = want.get(g, 0) + 1
    stretch, mining.STRETCH = mining.STRETCH, 50
    try:
        counts = mining.phrase_counts(frame, "words", ["^bo$"])
        got = {r.h: r.n for r in counts.collect()}
    finally:
        mining.STRETCH = stretch
    code = lambda w: mining._code(F.lit(w), F.lit(w).isin(mining.EDGE_WORDS), F.lit(w == "bo"))
    some = sorted(want, key=str)[:: max(1, len(want) // 40)]
    hashes = spark.range(1).select(*[F.xxhash64(*map(code, g)).alias(f"g{i}") for i, g in enumerate(some)]).first()
    assert [got[h] for h in hashes] == [want[g] for g in some]
    assert sorted(got.values()) == sorted(want.values()) and want
    plan = mining.phrase_counts(spark.createDataFrame([(["a", "b"],)], "words array<string>"), "words", [""])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
