"""All rules under all guards, read from the rows of the documents, with their SQL.

A wording for each rule is put into each of the frames below; SQL derives the
reading from the rule's contract (treatment, confidences, whether its own words
negate) and from what the frame does to it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prudentia.functions.treatment import RULES, SELF_NEGATING
from prudentia.operators import evaluation
from prudentia.plans.derived import table
from prudentia.schema import TREATMENTS

#: Words by which each rule speaks, in the order of the rules.
WORDINGS = [
    "procede apartarse de lo dicho en",
    "se apartó de tal postura en",
    "abandonar la jurisprudencia fijada en",
    "no es compatible con nuestro voto en",
    "variar la doctrina fijada en",
    "no comparte la conclusión alcanzada en",
    "fueron resueltas acertadamente en",
    "cabe estar a lo decidido en",
    "rige la doctrina que esta Corte reitera en",
    "con arreglo a la doctrina fijada en",
    "en el mismo sentido decidió",
    "tal como señaló el Tribunal en",
    "rige la doctrina de",
    "corresponde aplicar lo resuelto en",
    "es de aplicación lo dicho en",
    "lo dijo el conocido precedente sobre",
    "rige la doctrina sentada por este Tribunal en",
    "obliga la doctrina fijada en",
    "no resulta aplicable al caso lo dicho en",
    "a diferencia de lo juzgado en",
    "cabe acotar el alcance de",
    "no es aplicable cuando media",
    "sólo resulta aplicable lo dicho en",
    "ese criterio resulta criticable en",
]
#: What stands around the wording (%w) and the citation (%c).
FRAMES = {
    "plain": "Que %w %c en la especie.",
    "far": "Que %w esa materia. Asimismo rige %c en la especie.",
    "negated": "Que no %w %c en la especie.",
    "recital": 'En "Rolón" %w %c en la especie.',
    "attributed": "Que el recurrente dice que %w %c en la especie.",
    "approving": "Que %w, cfr. %c en la especie.",
    "reported": "Que el a quo entendió que %w %c en la especie.",
}


def _passages(spark, sf_dir):
    """A passage for every document; ``expected`` is how a lawyer reads it."""
    key = F.col("doc_id")
    of = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    rule, frame = F.pmod(key, F.lit(len(RULES))), F.pmod(F.floor(key / F.lit(float(len(RULES)))), F.lit(len(FRAMES)))
    named = table(spark, sf_dir, "documents").select(
        "doc_id", of(FRAMES, frame).alias("frame"), of(FRAMES.values(), frame).alias("around"), of(WORDINGS, rule).alias("words"), of([r[0] for r in RULES], rule).alias("treatment"),
        of([r[1] in SELF_NEGATING for r in RULES], rule).alias("negates"), F.format_string("Fallos: %d:%d", 300 + key % 50, 1 + key % 9000).alias("cited"),
    )
    doubtful = of([TREATMENTS[r[0]][0] in ("negative", "cautionary") for r in RULES], rule)
    heard = F.col("frame").isin("recital", "attributed", "reported") | ((F.col("frame") == "negated") & ~F.col("negates"))
    expected = F.when(heard | ((F.col("frame") == "approving") & doubtful), "mentioned").otherwise(F.col("treatment"))
    text = F.replace(F.col("around"), F.lit("%w"), F.col("words"))
    return named.withColumn("doubtful", doubtful).select("doc_id", "frame", expected.alias("expected"), F.replace(text, F.lit("%c"), F.col("cited")).alias("quote"), (F.instr(text, "%c") - 1).alias("position"))


def _read(spark, sf_dir):
    return evaluation.judged(_passages(spark, sf_dir), "quote", F.col("position"))


def rule_readings(spark, sf_dir):
    """How each passage is read."""
    return _read(spark, sf_dir).select("doc_id", "frame", "expected", "got", F.round("confidence", 6).alias("confidence"), "rule", "scope")


def rule_confusion(spark, sf_dir):
    return evaluation.confusion(_read(spark, sf_dir))


def rule_evaluation(spark, sf_dir):
    """Right readings, false departures and missed ones, in each frame."""
    return evaluation.evaluation(evaluation.confusion(_read(spark, sf_dir), "frame"), "frame")


_RULES = ", ".join(f"({k}, '{t}', '{name}', {near}::DOUBLE, {far}::DOUBLE, {str(name in SELF_NEGATING).lower()}, {str(TREATMENTS[t][0] in ('negative', 'cautionary')).lower()})" for k, (t, name, near, far, _) in enumerate(RULES))
_FRAMES = ", ".join(f"({k}, '{name}')" for k, name in enumerate(FRAMES))
_MADE = f"""WITH rules(k, treatment, name, near, far, negates, doubtful) AS (VALUES {_RULES}), frames(f, frame) AS (VALUES {_FRAMES}),
p AS (SELECT * FROM documents JOIN rules ON k = doc_id % {len(RULES)} JOIN frames ON f = doc_id // {len(RULES)} % {len(FRAMES)}),
r AS (SELECT doc_id, frame, treatment, name, near, far, doubtful,
  frame IN ('recital', 'attributed', 'reported') OR frame = 'negated' AND NOT negates OR frame = 'approving' AND doubtful AS heard,
  frame = 'negated' AND NOT negates OR frame = 'far' AND treatment = 'abandoned' AS silent,
  frame IN ('recital', 'attributed') OR frame = 'approving' AND doubtful AS guarded FROM p),
read AS (SELECT doc_id, frame, CASE WHEN heard THEN 'mentioned' ELSE treatment END AS expected,
  CASE WHEN silent OR guarded THEN 'mentioned' ELSE treatment END AS got,
  round(CASE WHEN silent THEN 0.2 WHEN guarded AND frame = 'attributed' THEN least(near, 0.4) WHEN guarded THEN 0.2 WHEN frame = 'far' THEN far ELSE near END, 6)::DOUBLE AS confidence,
  CASE WHEN silent THEN NULL ELSE name || CASE WHEN NOT guarded THEN '' ELSE CASE frame WHEN 'recital' THEN '(relato-historico)' WHEN 'attributed' THEN '(atribuido)' ELSE '(cita-de-apoyo)' END END END AS rule,
  CASE WHEN silent THEN 'fallback' WHEN frame = 'far' THEN 'passage' ELSE 'clause' END AS scope FROM r)
"""
SQL = {
    "rule_readings": _MADE + "SELECT * FROM read",
    "rule_confusion": _MADE + "SELECT expected, got, count(*) AS n FROM read GROUP BY 1, 2",
    "rule_evaluation": _MADE
    + "SELECT frame, count(*) AS n, count(*) FILTER (expected = got) AS correct, count(*) FILTER (got = 'abandoned' AND expected <> 'abandoned') AS false_red, count(*) FILTER (expected = 'abandoned' AND got <> 'abandoned') AS missed_red FROM read GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
