"""Is a ruling still good law?  Signals, evidence and caveats for all rulings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prudentia.schema import GRAY_CEILING, MAX_EVIDENCE, NEGATIVE_FLOOR, OPINIONS, TREATMENTS, UNREAD_CEILING, binding, polarity, severity


def with_years(citations: DataFrame, rulings: DataFrame) -> DataFrame:
    """Edges of existing citing rulings with ``year``; 0 and null mean unknown."""
    years = rulings.select(F.col("id").alias("citing_id"), F.coalesce("decided_year", F.lit(0)).alias("year"))
    return citations.join(years, "citing_id")


def flagged(edges: DataFrame, floor: float = NEGATIVE_FLOOR) -> DataFrame:
    """Edges with what each says: negative, weak, caution, positive, restores.

    A positive edge restores if every negative one of the same cited ruling has
    a known year and its own is later than all of them.  The two values that
    takes are summed up in each task before they are exchanged and then joined,
    so a leading case's edges are never one task's: the join can split them.
    """
    e = edges.withColumn("binding", binding()).withColumn("polarity", polarity()).withColumn("severity", severity())
    e = e.withColumn("negative", F.col("binding") & (F.col("polarity") == "negative") & (F.col("confidence") >= floor))
    e = e.withColumn("weak", F.col("binding") & (F.col("polarity") == "negative") & (F.col("confidence") < floor))
    e = e.withColumn("caution", F.col("binding") & (F.col("polarity") == "cautionary"))
    e = e.withColumn("positive", F.col("binding") & (F.col("polarity") == "positive"))
    late = e.where("negative").groupBy("cited_id").agg(F.max("year").alias("last_negative"), F.min("year").alias("first_negative"))
    e = e.join(late, "cited_id", "left")
    restores = F.col("positive") & (F.col("first_negative") > 0) & (F.col("year") > 0) & (F.col("year") > F.col("last_negative"))
    return e.withColumn("restores", F.coalesce(restores, F.lit(False)))


def _most(flag: str) -> Column:
    return F.max(F.when(F.col(flag), F.col("confidence")))


def signals(rulings: DataFrame, citations: DataFrame, floor: float = NEGATIVE_FLOOR) -> DataFrame:
    """A row per ruling: signal, confidence, counts.

    Rulings nobody cites are gray with confidence 0.
    """
    e = flagged(with_years(citations, rulings), floor)
    count = lambda c: F.count_if(c)
    per = e.groupBy("cited_id").agg(
        F.countDistinct("citing_id").alias("total_citing"),
        F.count("*").alias("n_records"),
        count(F.col("binding")).alias("n_binding"),
        count("negative").alias("n_negative"),
        count("weak").alias("n_weak"),
        count("caution").alias("n_caution"),
        count("positive").alias("n_positive"),
        count("restores").alias("n_restoring"),
        count(~F.col("binding") & (F.col("polarity") == "negative")).alias("n_nonbinding_negative"),
        count(F.col("binding") & (F.col("confidence") <= UNREAD_CEILING)).alias("n_unread"),
        _most("negative").alias("c_negative"),
        _most("caution").alias("c_caution"),
        _most("positive").alias("c_positive"),
        _most("restores").alias("c_restoring"),
        _most("binding").alias("c_binding"),
        # the latest restoring edge; ties go to the smaller id
        F.min(F.when(F.col("restores"), F.struct((-F.col("year")).alias("down"), "citing_id", "year"))).alias("newest"),
    )
    joined = rulings.select("id").join(per, F.col("id") == F.col("cited_id"), "left").drop("cited_id")
    counts = [c for c in joined.columns if c.startswith("n_") or c == "total_citing"]
    joined = joined.fillna(0, counts)
    restored = (F.col("n_negative") > 0) & (F.col("n_restoring") > 0)
    signal = F.when(restored, "yellow").when(F.col("n_negative") > 0, "red").when(F.col("n_caution") > 0, "yellow").when(F.col("n_positive") > 0, "green").otherwise("gray")
    best = F.when(restored, F.col("c_restoring")).when(F.col("n_negative") > 0, F.col("c_negative")).when(F.col("n_caution") > 0, F.col("c_caution")).when(F.col("n_positive") > 0, F.col("c_positive"))
    best = best.otherwise(F.least(F.coalesce("c_binding", F.lit(0.0)), F.lit(GRAY_CEILING)))
    out = joined.withColumn("signal", signal).withColumn("confidence", F.bround(F.coalesce(best, F.lit(0.0)), 3)).withColumn("restored", restored)
    out = out.withColumn("is_uniform", ~((F.col("n_negative") + F.col("n_weak") > 0) & (F.col("n_positive") > 0)))
    return out.drop("c_negative", "c_caution", "c_positive", "c_restoring", "c_binding")


def human(ident: str | Column) -> Column:
    """``fallos:V:P`` as people write it."""
    return F.regexp_replace(ident, "^fallos:", "Fallos: ")


def caveats(report: DataFrame, floor: float = NEGATIVE_FLOOR) -> DataFrame:
    """Add ``caveats``: what the signal alone would hide, in fixed order."""
    number = lambda c: F.col(c).cast("string")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    some = F.col("n_records") > 0
    # The texts that reports carry.
    texts = [
        (F.lit(True), F.lit("No hay fallos posteriores que lo citen en el corpus. Ausencia de tratamiento negativo no equivale a vigencia confirmada."), ~some),
        (F.col("signal") == "gray", say("Lo citan ", number("total_citing"), " fallo(s), pero ninguna cita pudo clasificarse como tratamiento. Gris significa que no se sabe, no que el precedente esté confirmado."), some),
        (F.col("restored"), say("El precedente fue abandonado y después retomado: ", human("newest.citing_id"), " (", number("newest.year"), ") vuelve a él. La señal no es roja por eso, pero la historia importa para citarlo: revisar el detalle antes de apoyarse en él."), some),
        (F.col("n_nonbinding_negative") > 0, say(number("n_nonbinding_negative"), " tratamiento(s) negativo(s) provienen de disidencias o votos propios. No son doctrina del tribunal y no determinan la señal."), some),
        (F.col("n_weak") > 0, say(number("n_weak"), f" tratamiento(s) clasificado(s) como negativo(s) por debajo del umbral de confianza ({floor:.2f}). Figuran en el detalle pero no encienden la señal roja."), some),
        (~F.col("is_uniform"), F.lit("El fallo fue abandonado en algún punto y aplicado en otro. La vigencia no es uniforme: revisar el detalle por tratamiento."), some),
        (F.col("n_binding") == 0, F.lit("Ninguno de los tratamientos pudo atribuirse al voto de la mayoría. La señal es indeterminada, no positiva."), some),
        (F.col("signal").isin("green", "yellow") & (F.col("n_unread") * 2 > F.col("n_binding")), say("Solo ", (F.col("n_binding") - F.col("n_unread")).cast("string"), " de ", number("n_binding"), " citas de la mayoría pudieron clasificarse; el resto quedó sin leer. La señal descansa en esa minoría y podría cambiar si se clasificaran las demás."), some),
        (F.col("signal") == "red", F.lit("Señal roja: verificar el pasaje citado antes de descartar el precedente. Esta es una herramienta de investigación, no un dictamen."), some),
    ]
    given = F.array(*[F.when(condition & scope, text) for condition, text, scope in texts])
    return report.withColumn("caveats", F.filter(given, lambda x: x.isNotNull()))


def evidence(rulings: DataFrame, citations: DataFrame, most: int = MAX_EVIDENCE) -> DataFrame:
    """The ``most`` gravest passages about each ruling: by severity, confidence,
    year, then citing ruling and quote."""
    e = with_years(citations, rulings).withColumn("severity", severity())
    order = W.partitionBy("cited_id").orderBy(F.col("severity").desc(), F.col("confidence").desc(), F.col("year").desc(), "citing_id", "quote", "treatment", "opinion", "method")
    return e.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def treatment_counts(citations: DataFrame) -> DataFrame:
    """Edges per cited ruling and treatment, all and binding ones."""
    return citations.groupBy("cited_id", "treatment").agg(F.count("*").alias("n"), F.count_if(binding()).alias("n_binding"))


def treatment_pivot(citations: DataFrame) -> DataFrame:
    """The same in a row per cited ruling, a column per treatment."""
    return citations.groupBy("cited_id").pivot("treatment", list(TREATMENTS)).count().fillna(0)


def nonbinding_by_opinion(citations: DataFrame) -> DataFrame:
    kinds = [o for o in OPINIONS if o != "majority"]
    return citations.where(F.col("opinion").isin(kinds)).groupBy("cited_id", "opinion").agg(F.count("*").alias("n"))
