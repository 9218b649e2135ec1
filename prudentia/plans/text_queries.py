"""Queries of the text functions, the reader and the resolver, with their SQL.

The test tables hold no court texts.  Where the pattern itself is what counts,
texts are made from keys by a template, and SQL states what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prudentia.functions import spans, text, treatment
from prudentia.operators import mining, resolve
from prudentia.plans.derived import GRAPH_SQL, dealt, rulings, table
from prudentia.sources.shared import new_dir
from prudentia.sources.text_index import TextIndex


def text_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.text_quality(F.col("text")), 6).alias("quality"), text.text_status(F.col("text")).alias("status"))


def clean_text(spark, sf_dir):
    raw = F.concat(F.lit(" \t"), F.regexp_replace("text", r"\. ", ".\r\n \t\r\n\n "), F.lit("￾ \n"))
    cleaned = text.clean_text(raw)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned.cast("binary")).alias("digest"), F.length(cleaned).cast("long").alias("n"))


def page_breaks(spark, sf_dir):
    raw = F.concat(F.substring("text", 1, 40), F.lit("-//- pie de pagina 12 -//-"), F.substring("text", 41, 60), F.lit(" -17- "), F.expr("substring(text, 101)"), F.lit("-//-"))
    return table(spark, sf_dir, "documents").select("doc_id", text.join_page_breaks(raw).alias("joined"))


def page_breaks_all(spark, sf_dir):
    """A page's end within a word after every 300 characters of the whole text,
    and a page number after 500 more."""
    raw = F.regexp_replace("text", r"(?s)(.{300})(.{1,500})", "$1-//- pie de pagina 12 -//-$2 -17- ")
    return table(spark, sf_dir, "documents").select("doc_id", text.join_page_breaks(raw).alias("joined"))


def strip_html(spark, sf_dir):
    stripped = text.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(stripped.cast("binary")).alias("digest"), F.length(stripped).cast("long").alias("n"))


def normalize_caption(spark, sf_dir):
    raw = F.concat(F.lit("Ñandú, "), F.col("c_name"), F.lit(" y otros s/ causa n° "), F.col("c_custkey").cast("string"), F.lit("."))
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_caption(raw).alias("key"), text.short_name_key(F.concat(F.lit(' "'), "c_mktsegment", F.lit('" '))).alias("short"))


def normalize_docket(spark, sf_dir):
    key = F.col("c_custkey")
    modern = F.format_string("CSJ %06d/%d/CS001", key + 1, 2013 + key % 9)
    classic = F.format_string("A. %d. XLIV. RHE", key % 9999 + 1)
    raw = F.when(key % 4 == 0, modern).when(key % 4 == 1, classic).when(key % 4 == 2, "CCC.").otherwise("no es un expediente")
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_docket(raw).alias("docket"))


def parse_ruling_id(spark, sf_dir):
    key = F.col("p_partkey")
    raw = F.when(key % 5 == 0, F.format_string("Fallos: %d:%d", 300 + key % 250, key)).when(key % 5 == 1, F.format_string(" %d : %d ", 300 + key % 50, key)).when(key % 5 == 2, F.format_string("FALLOS %d:%d", key % 600, key)).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_ruling_id(raw).alias("id"))


def parse_citing_html(spark, sf_dir):
    key = F.col("p_partkey")
    link = lambda v, p: F.format_string("<a href='#'> Fallos: %d:%d </a>", v, p)
    html = F.concat(link(300 + key % 250, key + 1), F.lit("<li>CSJ 001086/2022/CS001</li>"), link(F.lit(310), key % 7 + 1), link(300 + key % 250, key + 1))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.parse_citing(html), ",").alias("citing"))


def parse_api_record(spark, sf_dir):
    from prudentia.sources.records import parse_records

    key = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        F.to_json(
            F.struct(
                key.alias("id"),
                (300 + key % 50).alias("tomo"),
                (1 + key).alias("pagina"),
                F.when(key % 3 == 0, "").otherwise(F.col("p_name")).alias("caratulaWeb"),
                F.col("p_brand").alias("autos"),
                F.when(key % 2 == 0, F.format_string("%02d/%02d/%d", key % 28 + 1, key % 12 + 1, 1990 + key % 30)).otherwise(F.format_string("%d", 1950 + key % 40)).alias("fechaString"),
                F.when(key % 2 == 0, 1990 + key % 30).alias("anioFallo"),
                F.concat(F.lit("<p>"), F.col("p_type"), F.lit("</p>")).alias("texto"),
            )
        ).alias("value")
    )
    return parse_records(raw, "value").select("sumario_id", "id", "caption", "decided_on", "decided_year", "text", F.size("citing").alias("n_citing"))


def render_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.render_quote(F.col("text")).cast("binary")).alias("rendered"), text.trim_quote(F.col("text"), 80).alias("trimmed"))


# Passages by template: sentence with %s for the citation, what must be read.
_TEMPLATES = [
    ("Que corresponde apartarse de la doctrina de %s en este caso.", "abandoned", 0.9, "apartarse-de-la-doctrina"),
    ("Que la cuestion ha sido tratada y han sido resueltas acertadamente en %s por el juez.", "followed", 0.88, "resueltas-acertadamente-en"),
    ("Que cabe remitirse a lo resuelto en %s, en lo pertinente.", "followed", 0.85, "remision-a-lo-resuelto"),
    ("Que corresponde aplicar el criterio de %s al planteo.", "applied", 0.85, "corresponde-aplicar-el-criterio"),
    ("Que obliga la doctrina de %s a los tribunales.", "applied", 0.78, "obliga-la-doctrina"),
    ("Que lo decidido en %s no resulta aplicable al caso.", "distinguished", 0.8, "no-resulta-aplicable-al-caso"),
    ("Que corresponde limitar el alcance de %s a sus hechos.", "limited", 0.8, "limitar-el-alcance"),
    ("Que la doctrina de ese fallo es objetable (%s) por su base.", "criticized", 0.72, "objetable"),
    ("Que no corresponde apartarse de la doctrina de %s en autos.", "applied", 0.7, "doctrina-de"),
    ("Que se trata de una mera mencion de %s entre otras.", "mentioned", 0.2, None),
    ("Que el recurrente invoca la doctrina de %s sin fundamento.", "mentioned", 0.4, "doctrina-de(atribuido)"),
    ('En "Montalvo" corresponde aplicar el criterio de %s entonces.', "mentioned", 0.2, "corresponde-aplicar-el-criterio(relato-historico)"),
    ("Que la doctrina es criticable, conf. %s y sus citas.", "mentioned", 0.2, "objetable(cita-de-apoyo)"),
]


def passages(spark, sf_dir):
    """(key, quote, position, cited): a passage for every part."""
    key = F.col("p_partkey")
    cite = F.format_string("Fallos: %d:%d", 300 + key % 50, 1 + key % 9000)
    template = F.element_at(F.array(*[F.lit(t[0]) for t in _TEMPLATES]), (key % len(_TEMPLATES) + 1).cast("int"))
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(key.alias("key"), F.replace(template, F.lit("%s"), cite).alias("quote"), (F.instr(template, "%s") - 1).alias("position"), cite.alias("cited"))


def classify_passages(spark, sf_dir):
    return treatment.read_passages(passages(spark, sf_dir), "quote", F.col("position")).select("key", "r.treatment", "r.confidence", "r.rule")


def reclassify(spark, sf_dir):
    p = passages(spark, sf_dir)
    stored = p.select("key", "quote", "position", F.lit("mentioned").alias("treatment"), F.when(F.col("key") % 3 == 0, 0.9).otherwise(0.2).alias("confidence"), F.when(F.col("key") % 7 == 0, "manual").otherwise("rule").alias("method"))
    done = treatment.reclassify(stored, F.col("position"))
    return done.groupBy("treatment", "method").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


def confusion_matrix(spark, sf_dir):
    expected = F.element_at(F.array(*[F.lit(t[1]) for t in _TEMPLATES]), (F.col("key") % len(_TEMPLATES) + 1).cast("int"))
    got = treatment.read_passages(passages(spark, sf_dir), "quote", F.col("position")).select(expected.alias("expected"), "r")
    return got.groupBy("expected", F.col("r.treatment").alias("got")).agg(F.count("*").alias("n"))


def find_citations(spark, sf_dir):
    key = F.col("p_partkey")
    body = F.concat(
        F.lit("Considerando: Que cabe remitirse a lo resuelto en Fallos: "),
        F.format_string("%d:%d, %d; %d:%d", 300 + key % 50, 1 + key % 999, key % 90 + 10, 320 + key % 9, 7 + key % 99),
        F.lit(". Asi se decide.\nDISIDENCIA DEL SEÑOR MINISTRO DOCTOR DON CARLOS FAYT Considerando: Que "),
        F.format_string("Fallos 600:1 y Fallos: 450:%d", key % 500 + 1),
        F.lit(" no guarda analogia con el tema."),
    )
    docs = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.format_string("fallos:999:%d", key).alias("id"), body.alias("text"))
    return spans.extract_edges(docs).select("citing_id", "cited_id", "opinion", "treatment", "confidence", "rule")


def quotes(spark, sf_dir):
    """Passages around the citations of the made documents, with their length."""
    key = F.col("p_partkey")
    body = F.concat(F.repeat(F.concat(F.col("p_name"), F.lit(" ")), 40), F.lit(". Que Fallos: "), F.format_string("%d:%d", 300 + key % 50, 1 + key % 999), F.lit(" rige. "), F.repeat(F.lit("y mas "), 60))
    docs = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.format_string("fallos:999:%d", key).alias("id"), body.alias("text"))
    return spans.extract_edges(docs).select("citing_id", "cited_id", "quote")


def opinion_spans(spark, sf_dir):
    return find_citations(spark, sf_dir).groupBy("opinion").agg(F.count("*").alias("n"), F.countDistinct("cited_id").alias("n_cited"))


def llm_ground_cap(spark, sf_dir):
    p = passages(spark, sf_dir)
    evidence = F.when(F.col("key") % 2 == 0, F.upper(F.substring("quote", 5, 20))).otherwise("algo que nadie dijo")
    verdict = treatment.grounded(F.lit("followed"), (F.col("key") % 11) / F.lit(10.0), evidence, F.col("quote"))
    return p.select("key", verdict.alias("v")).select("key", "v.treatment", "v.confidence", "v.method")


def ngram_mining(spark, sf_dir):
    """Phrases of all documents with one of two stems."""
    folded = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: w != "")
    return mining.mine(table(spark, sf_dir, "documents").select("doc_id", folded.alias("words")), "words", 2, 50, stems=["the", "ing"])


def ngram_mining_all(spark, sf_dir):
    """All phrases of all words of all documents, whatever stem they have."""
    folded = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " "), lambda w: w != "")
    return mining.mine(table(spark, sf_dir, "documents").select("doc_id", folded.alias("words")), "words", 2, 50, stems=[""])


def resolve_batch(spark, sf_dir):
    nodes = rulings(spark, sf_dir)
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    aliases = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("EXP "), key.cast("string")).alias("raw"), F.format_string("fallos:%d:%d", 300 + key % 50, 1 + F.floor(key / F.lit(50.0))).alias("ruling_id"))
    asked = part.select(key.alias("query"), F.when(key % 3 == 0, F.format_string(" exp. %d ", key)).when(key % 3 == 1, F.format_string("Fallos: %d:%d", 300 + key % 60, 1 + F.floor(key / F.lit(50.0)))).otherwise("nada").alias("raw"))
    return resolve.resolve(asked, "raw", nodes, aliases).select("query", "resolved")


def _asked_all(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("query"), (300 + key % 50).cast("int").alias("volume"), (key % 60 + 1).cast("int").alias("page"))


def suggest_typo_all(spark, sf_dir):
    return resolve.suggest_typos(_asked_all(spark, sf_dir), rulings(spark, sf_dir)).select("query", "id")


def suggest_nearest_all(spark, sf_dir):
    return resolve.suggest_nearest(_asked_all(spark, sf_dir), rulings(spark, sf_dir))


def _named(spark, sf_dir):
    """Every part asked for by its whole name."""
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("query"), F.col("p_name").alias("raw"))


def fts_prefix_bm25_all(spark, sf_dir):
    """By a scan of all captions."""
    return resolve.suggest_captions(_named(spark, sf_dir), "raw", dealt(rulings(spark, sf_dir), "id"))


_indexes: dict[tuple[str, str], TextIndex] = {}


def caption_index(spark, sf_dir) -> TextIndex:
    """The index of all captions, stored once a session."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _indexes:
        _indexes[known] = TextIndex.build(dealt(rulings(spark, sf_dir), "id"), new_dir(spark, "captions"))
    return _indexes[known]


def fts_prefix_bm25(spark, sf_dir):
    """By the stored index."""
    return caption_index(spark, sf_dir).search(_named(spark, sf_dir), "raw")


#: The same under the names that the SQL has.
suggest_typo, suggest_nearest = suggest_typo_all, suggest_nearest_all


def suggest(spark, sf_dir):
    """Parts asked for by position, every third by its name."""
    key = F.col("p_partkey")
    asked = dealt(table(spark, sf_dir, "part"), "p_partkey").select(key.alias("query"), F.when(key % 3 == 0, F.col("p_name")).otherwise(F.format_string("Fallos: %d:%d", 300 + key % 50, key % 60 + 1)).alias("raw"))
    return resolve.suggest(asked, "raw", rulings(spark, sf_dir), captions=caption_index(spark, sf_dir).search)


def mined_before_citations(spark, sf_dir):
    """Phrases with one of the stems in the eight words before each citation that no
    rule could read: the passages of all parts, a fifth of them placeholders."""
    p = passages(spark, sf_dir)
    quote = F.when(F.col("key") % 5 == 0, F.concat(F.lit("referencia PUBLICADA por la CSJN en "), "cited")).otherwise(F.concat(F.lit("Se dijo: algo; "), "quote", F.lit(" Nada más.")))
    cited = F.regexp_replace(F.lower("cited"), " ", "")
    edges = p.select(F.col("key").alias("citing_id"), cited.alias("cited_id"), quote.alias("quote"), F.when(F.col("key") % 3 == 0, 0.9).otherwise(0.2).alias("confidence"))
    return mining.mine(mining.unread_windows(edges), "words", 2, 60)


_CITE = "'Fallos: ' || (300 + p_partkey % 50) || ':' || (1 + p_partkey % 9000)"


def _by_template(place: int, kind: str) -> str:
    values = ["NULL" if t[place] is None else repr(t[place]) for t in _TEMPLATES]
    return f"CAST((list_value({', '.join(values)}))[CAST(p_partkey % {len(_TEMPLATES)} + 1 AS INT)] AS {kind})"


_TOKENS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"
_WORD = "[A-Za-zÁÉÍÓÚÑÜáéíóúñü][A-Za-zÁÉÍÓÚÑÜáéíóúñü.,;:()«»\"''\\-]*"
_FOUND = """
f AS (
  SELECT p_partkey, 'fallos:999:' || p_partkey AS citing_id, unnest([
    {'cited_id': 'fallos:' || (300 + p_partkey % 50) || ':' || (1 + p_partkey % 999), 'opinion': 'majority', 'treatment': 'followed', 'confidence': 0.85::DOUBLE, 'rule': 'remision-a-lo-resuelto'},
    {'cited_id': 'fallos:' || (320 + p_partkey % 9) || ':' || (7 + p_partkey % 99), 'opinion': 'majority', 'treatment': 'followed', 'confidence': 0.552::DOUBLE, 'rule': 'remision-a-lo-resuelto'},
    {'cited_id': 'fallos:450:' || (p_partkey % 500 + 1), 'opinion': 'dissent', 'treatment': 'distinguished', 'confidence': 0.75::DOUBLE, 'rule': 'circunstancias-distintas'}]) AS c
  FROM part)"""

SQL = {
    "text_quality": f"""SELECT doc_id, round(q, 6) AS quality, CASE WHEN regexp_full_match(text, '\\s*') THEN 'unavailable' WHEN q >= 0.7 THEN 'extracted' ELSE 'garbled' END AS status
FROM (SELECT doc_id, text, CASE WHEN len(t) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(t, lambda x: length(x) >= 2 AND regexp_full_match(x, '{_WORD}') AND regexp_matches(x, '[aeiouáéíóúAEIOUÁÉÍÓÚ]')))::DOUBLE / len(t) END AS q
      FROM (SELECT doc_id, text, {_TOKENS} AS t FROM documents))""",
    "clean_text": """SELECT doc_id, md5(c) AS digest, length(c) AS n FROM (
  SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(replace(replace(replace(r, chr(65534), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), chr(10)), lambda l: trim(l, ' ')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS c
  FROM (SELECT doc_id, ' ' || chr(9) || replace(text, '. ', '.' || chr(13) || chr(10) || ' ' || chr(9) || chr(13) || chr(10) || chr(10) || ' ') || chr(65534) || ' ' || chr(10) AS r FROM documents))""",
    "page_breaks": "SELECT doc_id, regexp_replace(substr(text, 1, 100) || ' ' || substr(text, 101), '[ \\t]{2,}', ' ', 'g') AS joined FROM (SELECT doc_id, text FROM documents)",
    "strip_html": "SELECT page_id, md5(s) AS digest, length(s) AS n FROM (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS s FROM pages)",
    "normalize_caption": "SELECT c_custkey, 'NANDU ' || upper(replace(c_name, '#', ' ')) AS key, upper(c_mktsegment) AS short FROM customer",
    "normalize_docket": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'CSJ.' || (c_custkey + 1) || '/' || (2013 + c_custkey % 9) || '/CS001' WHEN 1 THEN 'A.' || (c_custkey % 9999 + 1) || '.XLIV' END AS docket FROM customer",
    "parse_ruling_id": """SELECT p_partkey, CASE WHEN v BETWEEN 1 AND 500 AND p_partkey BETWEEN 1 AND 9999 THEN 'fallos:' || v || ':' || p_partkey END AS id
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 300 + p_partkey % 250 WHEN 1 THEN 300 + p_partkey % 50 WHEN 2 THEN p_partkey % 600 END AS v FROM part)""",
    "parse_citing_html": """SELECT p_partkey, concat_ws(',', CASE WHEN a IS NOT NULL THEN a END, CASE WHEN a IS DISTINCT FROM b THEN b END) AS citing
FROM (SELECT p_partkey, CASE WHEN 300 + p_partkey % 250 <= 500 AND p_partkey + 1 <= 9999 THEN 'fallos:' || (300 + p_partkey % 250) || ':' || (p_partkey + 1) END AS a, 'fallos:310:' || (p_partkey % 7 + 1) AS b FROM part)""",
    "parse_api_record": """SELECT p_partkey AS sumario_id, 'fallos:' || (300 + p_partkey % 50) || ':' || (1 + p_partkey) AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS caption,
  CASE WHEN p_partkey % 2 = 0 THEN printf('%02d/%02d/%d', p_partkey % 28 + 1, p_partkey % 12 + 1, 1990 + p_partkey % 30) END AS decided_on,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_partkey % 30 ELSE 1950 + p_partkey % 40 END AS INT) AS decided_year, p_type AS text, 0 AS n_citing FROM part WHERE 1 + p_partkey <= 9999""",
    "render_quote": """SELECT doc_id, md5('> ' || replace(replace(CASE WHEN length(f) > 1200 THEN substr(f, 1, 1200) || '… [pasaje recortado]' ELSE f END, '`', ''''), '>', '›')) AS rendered,
  CASE WHEN length(f) > 80 THEN rtrim(substr(f, 1, 80), ' ') || '…' ELSE f END AS trimmed
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS f FROM documents)""",
    "classify_passages": f"SELECT p_partkey AS key, {_by_template(1, 'VARCHAR')} AS treatment, {_by_template(2, 'DOUBLE')} AS confidence, {_by_template(3, 'VARCHAR')} AS rule FROM part",
    "reclassify": f"""SELECT treatment, method, count(*) AS n, count(*) FILTER (changed) AS n_changed FROM (
  SELECT CASE WHEN due THEN t ELSE 'mentioned' END AS treatment, CASE WHEN due THEN 'rule' ELSE m END AS method, due AND (t <> 'mentioned' OR c <> 0.2) AS changed FROM (
    SELECT {_by_template(1, 'VARCHAR')} AS t, {_by_template(2, 'DOUBLE')} AS c, CASE WHEN p_partkey % 7 = 0 THEN 'manual' ELSE 'rule' END AS m, p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AS due FROM part)) GROUP BY 1, 2""",
    "confusion_matrix": f"SELECT t AS expected, t AS got, count(*) AS n FROM (SELECT {_by_template(1, 'VARCHAR')} AS t FROM part) GROUP BY 1, 2",
    "find_citations": "WITH " + _FOUND + " SELECT citing_id, c.cited_id, c.opinion, c.treatment, c.confidence, c.rule FROM f",
    "quotes": """SELECT 'fallos:999:' || p_partkey AS citing_id, 'fallos:' || (300 + p_partkey % 50) || ':' || (1 + p_partkey % 999) AS cited_id,
  trim(regexp_replace(substr(body, instr(body, raw) - 320, 520 + length(raw)), ' +', ' ', 'g'), ' ') AS quote
FROM (SELECT *, repeat(p_name || ' ', 40) || '. Que Fallos: ' || raw || ' rige. ' || repeat('y mas ', 60) AS body
      FROM (SELECT p_partkey, p_name, (300 + p_partkey % 50) || ':' || (1 + p_partkey % 999) AS raw FROM part))""",
    "opinion_spans": "WITH " + _FOUND + " SELECT c.opinion AS opinion, count(*) AS n, count(DISTINCT c.cited_id) AS n_cited FROM f GROUP BY 1",
    "llm_ground_cap": "SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'followed' END AS treatment, CASE WHEN p_partkey % 2 = 0 THEN least((p_partkey % 11) / 10.0::DOUBLE, 0.7::DOUBLE) END AS confidence, CASE WHEN p_partkey % 2 = 0 THEN 'llm' END AS method FROM part",
    "resolve_batch": GRAPH_SQL + """SELECT p_partkey AS query, CASE p_partkey % 3 WHEN 0 THEN 'fallos:' || (300 + p_partkey % 50) || ':' || (1 + CAST(floor(p_partkey / 50.0) AS INT))
  WHEN 1 THEN (SELECT id FROM rulings WHERE id = 'fallos:' || (300 + p_partkey % 60) || ':' || (1 + CAST(floor(p_partkey / 50.0) AS INT))) END AS resolved FROM part""",
    "fts_prefix_bm25": GRAPH_SQL
    + """,
words AS (SELECT id, string_split(trim(regexp_replace(regexp_replace(upper(caption), '[^A-Z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')), ' ') AS ws FROM rulings),
terms AS (SELECT id, len(ws) AS size, unnest(ws) AS term FROM words),
stats AS (SELECT count(*)::DOUBLE AS docs, avg(len(ws)) AS mean FROM words),
asked AS (SELECT p_partkey AS query, unnest(string_split(upper(p_name), ' ')) AS w FROM part),
pre AS (SELECT DISTINCT query, substr(w, 1, greatest(4, CAST(floor(length(w) * 0.7) AS INT))) AS prefix FROM asked WHERE length(w) > 2),
hit AS (SELECT query, prefix, id, size, count(*) AS tf FROM pre JOIN terms ON starts_with(term, prefix) GROUP BY ALL),
scored AS (SELECT *, count(*) OVER (PARTITION BY query, prefix) AS df FROM hit),
total AS (SELECT query, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score FROM scored, stats GROUP BY 1, 2)
SELECT query, CAST(place AS INT) AS place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM total) WHERE place <= 5""",
    "suggest_nearest": GRAPH_SQL + """SELECT query, CAST(place AS INT) AS place, id FROM (
  SELECT q.query, r.id, row_number() OVER (PARTITION BY q.query ORDER BY abs(r.page - q.page), r.page) AS place
  FROM (SELECT p_partkey AS query, 300 + p_partkey % 50 AS volume, p_partkey % 60 + 1 AS page FROM part) q JOIN rulings r USING (volume)) WHERE place <= 5""",
    "suggest_typo": GRAPH_SQL + """SELECT DISTINCT q.query, r.id FROM (SELECT p_partkey AS query, 300 + p_partkey % 50 AS volume, p_partkey % 60 + 1 AS page FROM part) q
JOIN rulings r ON r.volume = q.volume AND r.page <> q.page AND r.page > 0 AND (
  (q.page < 10 AND r.page < 10)
  OR (q.page >= 10 AND (r.page = (q.page % 10) * 10 + q.page // 10 OR (r.page < 100 AND (r.page // 10 = q.page // 10 OR r.page % 10 = q.page % 10)))))""",
    "ngram_mining": """WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, range(2, 7) AS a(n)),
g AS (SELECT doc_id, ws[i:i + n - 1] AS gram FROM s),
e AS (SELECT doc_id, gram, list_filter(range(1, len(gram) + 1), lambda j: NOT list_contains(string_split('de del la el los las y e o u a al en que por con un una su sus se lo es', ' '), list_extract(gram, j))) AS kept FROM g),
t AS (SELECT DISTINCT doc_id, array_to_string(list_slice(gram, list_min(kept), list_max(kept)), ' ') AS gram FROM e WHERE len(kept) > 0 AND list_max(kept) - list_min(kept) >= 1)
SELECT gram, count(*) AS n FROM t WHERE regexp_matches(gram, 'the|ing') GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, gram LIMIT 50""",
}

SQL["fts_prefix_bm25_all"] = SQL["fts_prefix_bm25"]
SQL["suggest"] = (
    SQL["fts_prefix_bm25"].split("\nSELECT query, CAST(place AS INT)")[0].replace("FROM part),\npre", "FROM part WHERE p_partkey % 3 = 0),\npre")
    + """,
named AS (SELECT query, 3 AS stage, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place, id FROM total),
q AS (SELECT p_partkey AS query, 300 + p_partkey % 50 AS volume, p_partkey % 60 + 1 AS page FROM part WHERE p_partkey % 3 <> 0),
tried AS (
  SELECT query, volume, page, 0 AS place, page % 10 * 10 + page // 10 AS slip FROM q WHERE page >= 10
  UNION ALL SELECT query, volume, page, 1 + d, d * 10 + page % 10 FROM q, range(10) AS a(d) WHERE page >= 10
  UNION ALL SELECT query, volume, page, 11 + d, page // 10 * 10 + d FROM q, range(10) AS a(d)),
slips AS (SELECT query, 1 AS stage, min(place) AS place, 'fallos:' || volume || ':' || slip AS id FROM tried WHERE slip > 0 AND slip <> page GROUP BY ALL),
near AS (SELECT q.query, 2 AS stage, row_number() OVER (PARTITION BY q.query ORDER BY abs(r.page - q.page), r.page) AS place, r.id FROM q JOIN rulings r USING (volume)),
every AS (SELECT s.* FROM slips s JOIN rulings r USING (id) UNION ALL SELECT * FROM near WHERE place <= 5 UNION ALL SELECT * FROM named WHERE place <= 5),
best AS (SELECT query, id, min(stage * 1000 + place) AS spot FROM every GROUP BY ALL)
SELECT query, CAST(rank AS INT) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY spot, id) AS rank FROM best) WHERE rank <= 5"""
)

NAMES = ["text_quality", "clean_text", "page_breaks", "strip_html", "normalize_caption", "normalize_docket", "parse_ruling_id", "parse_citing_html", "parse_api_record", "render_quote", "classify_passages", "reclassify", "confusion_matrix", "find_citations", "quotes", "opinion_spans", "llm_ground_cap", "ngram_mining", "resolve_batch", "suggest_typo", "suggest_nearest", "fts_prefix_bm25", "suggest", "suggest_typo_all", "suggest_nearest_all", "fts_prefix_bm25_all", "page_breaks_all", "ngram_mining_all", "mined_before_citations"]
QUERIES = {name: globals()[name] for name in NAMES}
