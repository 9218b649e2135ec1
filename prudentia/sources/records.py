"""Sources: fixture documents, API records, PDF files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prudentia.functions.text import normalize_caption, parse_citing, ruling_key, short_name_key, strip_html
from prudentia.schema import CITATIONS, MAX_PAGE, RULINGS
from prudentia.sources.store import GraphStore

MAX_PDF_BYTES = 64 << 20

_RECORD = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("tomo", T.IntegerType()),
        T.StructField("pagina", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("caratulaWeb", "autos", "fechaString")],
        T.StructField("anioFallo", T.IntegerType()),
        T.StructField("numeroExpediente", T.StringType()),
        T.StructField("idFallo", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("texto", "voces", "stringVotosMayoria", "stringVotosVoto", "stringVotosDisidencia", "stringVotosDisidenciaParcial", "linksCitantes")],
    ]
)


def parse_records(raw: DataFrame, value: str, keep: tuple[str, ...] = (), last_page: int = MAX_PAGE) -> DataFrame:
    """API records (JSON text) as typed rows, with the columns ``keep`` of the
    input; records without a position in range (pages up to ``last_page``) are left
    out."""
    r = raw.select(*keep, F.from_json(value, _RECORD).alias("r")).select(*keep, "r.*")
    filled = lambda c: F.nullif(F.btrim(F.col(c)), F.lit(""))
    date = filled("fechaString")
    year = F.coalesce("anioFallo", F.nullif(F.regexp_extract(date, r"(\d{4})$", 1), F.lit("")).cast("int"), F.lit(0))
    return r.select(
        F.col("id").alias("sumario_id"),
        ruling_key(F.col("tomo"), F.col("pagina"), last_page).alias("id"),
        F.col("tomo").alias("volume"),
        F.col("pagina").alias("page"),
        F.coalesce(filled("caratulaWeb"), filled("autos"), F.lit("")).alias("caption"),
        F.when(date.rlike(r"^\d{2}/\d{2}/\d{4}$"), date).alias("decided_on"),
        year.alias("decided_year"),
        filled("numeroExpediente").alias("docket"),
        F.col("idFallo").alias("csjn_doc_id"),
        strip_html(F.col("texto")).alias("text"),
        *[F.coalesce(F.btrim(F.col(c)), F.lit("")).alias(n) for c, n in (("voces", "voices"), ("stringVotosMayoria", "votes_majority"), ("stringVotosVoto", "votes_concurrence"), ("stringVotosDisidencia", "votes_dissent"), ("stringVotosDisidenciaParcial", "votes_partial_dissent"))],
        parse_citing(F.col("linksCitantes"), last_page).alias("citing"),
        *keep,
    ).where("id IS NOT NULL AND sumario_id IS NOT NULL")


_FIXTURE = T.StructType(
    [
        T.StructField("rulings", T.ArrayType(RULINGS)),
        T.StructField("aliases", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("edges", T.ArrayType(CITATIONS)),
    ]
)


def read_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rulings, edges, aliases) of JSON documents of hand-read cases.

    Aliases are the stated ones, (form as written, kind, ruling), and what each
    ruling is known by anyway: its id, its caption and its short name as they are
    looked up.  Lists that a document lacks are empty; an alias without a form or
    a ruling, and a ruling or edge without ids, are left out.  A document is
    one row until it is taken apart, as fixtures are small files.
    """
    doc = spark.read.option("multiLine", True).schema(_FIXTURE).json(path)
    rulings = doc.select(F.explode("rulings").alias("r")).select("r.*").where("id IS NOT NULL")
    edges = doc.select(F.explode("edges").alias("e")).select("e.*").where("citing_id IS NOT NULL AND cited_id IS NOT NULL")
    known = F.array(*[F.struct(raw.alias("raw"), F.lit(form).alias("form")) for form, raw in (("fallos", F.col("id")), ("caption", normalize_caption(F.col("caption"))), ("short_name", short_name_key(F.col("short_name"))))])
    own = rulings.select(F.col("id").alias("ruling_id"), F.explode(known).alias("a")).select("a.raw", "ruling_id", "a.form")
    stated = doc.select(F.explode("aliases").alias("a")).select(F.get("a", F.lit(0)).alias("raw"), F.get("a", F.lit(2)).alias("ruling_id"), F.get("a", F.lit(1)).alias("form"))
    aliases = stated.union(own).where("length(trim(raw)) > 0 AND ruling_id IS NOT NULL").distinct()
    return rulings, edges, aliases.withColumn("source", F.lit("manual"))


def load_fixture(store: GraphStore, path: str) -> GraphStore:
    """The store after one commit that merges the hand-read cases into it; loading
    them again changes no row."""
    rulings, edges, aliases = read_fixture(store.spark, path)
    earlier = [s for s in store.meta.get("sources", "").split(" + ") if s]
    sources = " + ".join(dict.fromkeys([*earlier, "fixture"]))
    return store.merge(rulings, edges, aliases, meta={"sources": sources})


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, digest) of PDF files within the size bound."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.where((F.col("length") <= MAX_PDF_BYTES) & (F.substring("content", 1, 4) == F.lit(b"%PDF"))).select("path", "content", F.sha2("content", 256).alias("digest"))
