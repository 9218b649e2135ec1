"""Idempotent upserts as folds over an append-only log.

A log row carries what one write said; ``seq`` columns order the writes.
Folding keeps, per key, the last or the first value, so that replaying any part
of the log changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.functions.text import normalize_caption, normalize_docket
from prudentia.schema import FORMS, MAX_PAGE, MAX_VOLUME, METHODS, OPINIONS, TEXT_STATUSES, TREATMENTS


def _order(seq: list[str]) -> Column:
    return F.struct(*seq)


def fold_rulings(log: DataFrame, seq: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Rulings: description and text state are what was written last, even if
    null; short name, date and document id are the last that was not null.
    ``also`` names columns that hang on the key, which stay (in every fold)."""
    order = _order(seq)
    last, first = ("caption", "decided_year", "source_url", "text_status", "text_quality"), ("volume", "page")
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("short_name", "decided_on", "csjn_doc_id")]
    return log.groupBy("id", *also).agg(F.min_by(F.struct(*first), order).alias("_first"), F.max_by(F.struct(*last), order).alias("_last"), *kept).select("id", *also, "_first.*", "_last.*", "short_name", "decided_on", "csjn_doc_id")


def fold_aliases(log: DataFrame, seq: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Aliases: the ruling written last, form and source written first."""
    order = _order(seq)
    some = log.where(F.length(F.trim("raw")) > 0)
    return some.groupBy("raw", *also).agg(F.max_by("ruling_id", order).alias("ruling_id"), F.min_by("form", order).alias("form"), F.min_by("source", order).alias("source"))


def fold_citations(log: DataFrame, seq: list[str], also: tuple[str, ...] = (), key: tuple[str, ...] = ("citing_id", "cited_id", "quote")) -> DataFrame:
    """Citations: per pair and quote the last reading and the first record.  Rows that
    lie in the order of ``also`` and ``key`` need no sort for it, and leave it so."""
    order, key = _order(seq), (*also, *key)
    last = F.struct("treatment", "opinion", "confidence", "method")  # one order for all of them, which an exchange would carry four times
    return log.groupBy(*key).agg(F.max_by(last, order).alias("_last"), F.min_by("sumario_id", order).alias("sumario_id")).select(*key, "_last.*", "sumario_id")


def fold_meta(log: DataFrame, seq: list[str]) -> DataFrame:
    return log.groupBy("key").agg(F.max_by("value", _order(seq)).alias("value"))


def add_source(sources: Column, new: Column) -> Column:
    """A ``" + "``-joined set with one more member, order kept."""
    return F.array_join(F.array_distinct(F.concat(F.filter(F.split(sources, r" \+ "), lambda x: x != ""), F.array(new))), " + ")


def mark_done(done: Column, volume: Column) -> Column:
    """A sorted, comma-joined set of volumes with one more."""
    have = F.transform(F.filter(F.split(done, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(F.concat(have, F.array(volume.cast("int"))))), lambda x: x.cast("string")), ",")


def stub_rulings(citations: DataFrame, rulings: DataFrame) -> DataFrame:
    """A node for every ruling that edges name and the table lacks."""
    ends = citations.select(F.col("citing_id").alias("id")).union(citations.select(F.col("cited_id").alias("id"))).distinct()
    parts = F.split("id", ":")
    return ends.join(rulings.select("id"), "id", "left_anti").select(
        "id",
        F.element_at(parts, 2).cast("int").alias("volume"),
        F.element_at(parts, 3).cast("int").alias("page"),
        F.regexp_replace("id", "^fallos:", "Fallos: ").alias("caption"),
        F.lit(None).cast("string").alias("short_name"),
        F.lit(None).cast("string").alias("decided_on"),
        F.lit(0).alias("decided_year"),
        source_url(F.element_at(parts, 2), F.element_at(parts, 3)).alias("source_url"),
        F.lit("unavailable").alias("text_status"),
        F.lit(None).cast("double").alias("text_quality"),
        F.lit(None).cast("long").alias("csjn_doc_id"),
    )


def source_url(volume: Column, page: Column) -> Column:
    return F.concat(F.lit("https://sjconsulta.csjn.gov.ar/sjconsulta/consultaSumarios/buscarTomoPagina.html?tomo="), volume.cast("string"), F.lit("&pagina="), page.cast("string"))


def _first_of(*rules: tuple[Column, str]) -> Column:
    reason = F.when(F.lit(False), "")
    for broken, name in rules:
        reason = reason.when(F.coalesce(broken, F.lit(True)), name)
    return reason.otherwise("accepted")


def checked_citations(log: DataFrame) -> DataFrame:
    """Add ``reason``: ``accepted`` or the first constraint that a row breaks;
    null in a checked column breaks it.  Rejected rows never stop a load."""
    return log.withColumn(
        "reason",
        _first_of(
            (F.length(F.trim("quote")) == 0, "blank quote"),
            (~F.col("confidence").between(0, 1), "confidence out of range"),
            (F.col("citing_id") == F.col("cited_id"), "cites itself"),
            (~F.col("treatment").isin(*TREATMENTS), "treatment"),
            (~F.col("opinion").isin(*OPINIONS), "opinion"),
            (~F.col("method").isin(*METHODS), "method"),
        ),
    )


def checked_rulings(log: DataFrame, last_page: int = MAX_PAGE) -> DataFrame:
    return log.withColumn("reason", _first_of((~F.col("volume").between(1, MAX_VOLUME), "volume"), (~F.col("page").between(1, last_page), "page"), (F.col("caption").isNull(), "caption"), (~F.col("text_status").isin(*TEXT_STATUSES), "text status")))


def checked_aliases(log: DataFrame) -> DataFrame:
    return log.withColumn("reason", _first_of((F.length(F.trim("raw")) == 0, "blank"), (~F.col("form").isin(*FORMS), "form")))


def checked_load(checked: DataFrame, key: list[str], order: list[str], stored: DataFrame | None = None, ends: dict[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Constraints between rows, after those of single rows (column ``reason``).

    UNIQUE: of the accepted rows of one ``key`` the first in ``order`` stays, others
    are ``repeated in the load``; a key that ``stored`` has is ``stored before``.
    Foreign keys: a row whose column in ``ends`` names no ``id`` of ``known`` gets
    that column's reason.  A row has the first reason that applies: its own, a
    missing end, stored, repeated; so what is repeated is told among the rows that
    could stay.  Rows that agree in key and order all stay or go together.  All of
    it is joins and one aggregate; nulls in a key are equal to each other and
    nulls in an end are missing.
    """
    rows = checked
    for column, reason in (ends or {}).items():
        there = known.select(F.col("id").alias("_id"), F.lit(True).alias("_there")).distinct()
        rows = rows.join(there, F.col(column) == F.col("_id"), "left")
        rows = rows.withColumn("reason", F.when((F.col("reason") == "accepted") & F.col("_there").isNull(), reason).otherwise(F.col("reason"))).drop("_id", "_there")
    names = [f"_k{i}" for i in range(len(key))]
    alike = lambda: [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names, strict=True)]
    if stored is not None:
        had = stored.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], F.lit(True).alias("_had")).distinct()
        rows = rows.join(had, alike(), "left")
        rows = rows.withColumn("reason", F.when((F.col("reason") == "accepted") & F.col("_had").isNotNull(), "stored before").otherwise(F.col("reason"))).drop(*names, "_had")
    first = rows.where("reason = 'accepted'").groupBy(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)]).agg(F.min(F.struct(*order)).alias("_first"))
    rows = rows.join(first, alike(), "left")
    later = (F.col("reason") == "accepted") & ~F.struct(*order).eqNullSafe(F.col("_first"))
    return rows.withColumn("reason", F.when(later, "repeated in the load").otherwise(F.col("reason"))).drop(*names, "_first")


# The passage that stands for an edge which nobody has read yet.
PLACEHOLDER_QUOTE = "Referencia publicada por la CSJN en el sumario %d de Fallos: %d:%d. Sin clasificar: falta el pasaje."


def edges_of_records(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The edges that source records state: each ruling in ``citing`` cites the
    record's own; edges to itself are dropped and await a reading."""
    return (
        records.select("sumario_id", F.col("id").alias("cited_id"), "volume", "page", F.explode("citing").alias("citing_id"), *keep)
        .where("citing_id <> cited_id")
        .select("citing_id", "cited_id", F.lit("mentioned").alias("treatment"), F.lit("unknown").alias("opinion"), F.lit(0.2).alias("confidence"), F.format_string(PLACEHOLDER_QUOTE, "sumario_id", "volume", "page").alias("quote"), F.lit("rule").alias("method"), "sumario_id", *keep)
    )


def aliases_of_records(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The forms under which source records' rulings are known: the id itself, the
    caption and the docket as they are looked up."""
    forms = (("fallos", F.col("id")), ("caption", normalize_caption(F.col("caption"))), ("expediente", normalize_docket(F.col("docket"))))
    each = F.array(*[F.struct(raw.alias("raw"), F.lit(form).alias("form")) for form, raw in forms])
    return records.select("id", F.explode(each).alias("a"), *keep).where("length(trim(a.raw)) > 0").select("a.raw", F.col("id").alias("ruling_id"), "a.form", F.lit("api").alias("source"), *keep)
