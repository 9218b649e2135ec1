"""How a passage treats the ruling it cites: an auditable rule set.

Rules are tried on the clause around the citation, then on the whole passage at
a lower confidence.  Guards withdraw what belongs to another court's history, to
an approving citation or to a party's argument.  The engine runs inside Arrow
batches; Java's regular expressions differ from the rules' in look-around and
Unicode classes, which is why it is not a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prudentia.schema import FALLBACK_CONFIDENCE, MODEL_CEILING, TREATMENTS, is_placeholder

# The formulas of the rule set, in order: treatment, name,
# confidence, confidence when found outside the clause (0 where that never
# counts), pattern.
RULES = [
    ("abandoned", "apartarse-de-la-doctrina", 0.90, 0.0, r"(?:corresponde|cabe|procede)\s+apartarse\s+de(?:\s+la\s+doctrina)?"),
    ("abandoned", "se-aparto-de-tal-doctrina", 0.88, 0.0, r"se\s+apart[óo]\s+de\s+tal"),
    ("abandoned", "abandonar-la-doctrina", 0.85, 0.0, r"(?:abandonar|dejar\s+sin\s+efecto|revisar)\s+(?:la\s+)?(?:doctrina|criterio|jurisprudencia)"),
    ("abandoned", "no-es-compatible-con-el-criterio", 0.82, 0.0, r"no\s+(?:es|resulta)\s+compatible[^.;]{0,60}(?:criterio|doctrina|voto)"),
    ("abandoned", "modificar-la-doctrina", 0.82, 0.0, r"(?:modificar|rectificar|variar)\s+(?:el\s+criterio|la\s+doctrina)"),
    ("abandoned", "no-comparte-la-doctrina", 0.78, 0.0, r"no\s+(?:comparte|comparten)[^.;]{0,50}(?:doctrina|criterio|conclusi[óo]n)"),
    ("followed", "resueltas-acertadamente-en", 0.88, 0.572, r"(?:han\s+sido|fueron)\s+resueltas?\s+acertadamente\s+en"),
    ("followed", "remision-a-lo-resuelto", 0.85, 0.552, r"(?:cabe|corresponde)\s+(?:remitirse|estar)\s+a\s+lo\s+(?:resuelto|decidido)"),
    ("followed", "doctrina-que-el-tribunal-comparte", 0.85, 0.552, r"doctrina\s+que\s+(?:el\s+Tribunal|esta\s+Corte)\s+(?:comparte|reitera)"),
    ("followed", "conforme-la-doctrina-de", 0.78, 0.507, r"(?:de\s+conformidad\s+con|conforme|con\s+arreglo\s+a)\s+(?:la\s+|el\s+)?(?:doctrina|criterio|precedente)"),
    ("followed", "en-igual-sentido", 0.72, 0.468, r"en\s+(?:igual|el\s+mismo)\s+sentido"),
    ("followed", "tal-como-resolvio-el-tribunal", 0.80, 0.520, r"(?:tal\s+como|conforme|según)\s+(?:lo\s+)?(?:expuso|sostuvo|señaló|resolvió|decidió|estableció)\s+(?:el\s+Tribunal|esta\s+Corte|la\s+Corte)"),
    ("applied", "doctrina-de", 0.70, 0.455, r"doctrina\s+(?:de|del)\b(?!\s*(?:la\s+)?(?:arbitrariedad|real\s+malicia))"),
    ("applied", "corresponde-aplicar-el-criterio", 0.85, 0.552, r"(?:corresponde|cabe)\s+aplicar\s+(?:el\s+criterio|la\s+doctrina|lo\s+resuelto)"),
    ("applied", "resulta-aplicable-la-doctrina", 0.75, 0.488, r"(?:resulta|es)\s+(?:de\s+)?aplicaci[óo]n|resulta\s+aplicable\s+(?:la\s+doctrina|el)"),
    ("applied", "precedente-invocado", 0.70, 0.455, r"(?:en\s+el|el|del|al)\s+(?:tradicional\s+|citado\s+|conocido\s+|mencionado\s+)?precedentes?\s+(?:publicado\s+en\s+|registrado\s+en\s+|de\s+)?"),
    ("applied", "doctrina-sentada-por-la-corte", 0.75, 0.488, r"doctrina\s+sentada\s+por\s+(?:esta\s+Corte|el\s+Tribunal|este\s+Tribunal)"),
    ("applied", "obliga-la-doctrina", 0.78, 0.507, r"obliga\s+la\s+doctrina"),
    ("distinguished", "no-resulta-aplicable-al-caso", 0.80, 0.520, r"no\s+(?:resulta|es)\s+aplicable[^.;]{0,60}(?:al\s+caso|sub\s+lite|autos)"),
    ("distinguished", "circunstancias-distintas", 0.75, 0.488, r"(?:a\s+diferencia\s+de|no\s+guarda\s+analog[íi]a|(?:las\s+)?circunstancias[^.;]{0,40}(?:difieren|distintas))"),
    ("limited", "limitar-el-alcance", 0.80, 0.520, r"(?:limitar|circunscribir|restringir|acotar)\s+(?:el\s+alcance|los\s+alcances)"),
    ("limited", "no-resulta-aplicable-cuando", 0.75, 0.488, r"no\s+(?:resulta|es)\s+aplicable\s+cuando"),
    ("limited", "solo-resulta-aplicable", 0.72, 0.468, r"s[óo]lo\s+(?:resulta|es)\s+aplicable"),
    ("criticized", "objetable", 0.72, 0.468, r"(?:doctrina|criterio|precedente|jurisprudencia|standard|est[áa]ndar)(?:\s+\S+){0,5}?\s+(?:es|son|resulta|resultan)\s+(?:objetable|objetables|criticable|criticables)|(?:doctrina|criterio|precedente|jurisprudencia)(?:\s+\S+){0,5}?\s+ha\s+sido\s+objeto\s+de\s+cr[íi]ticas"),
]
# Rules whose own words negate, and the patterns of the guards.
SELF_NEGATING = {"no-es-compatible-con-el-criterio", "no-comparte-la-doctrina", "no-resulta-aplicable-al-caso", "circunstancias-distintas"}
# Of these stems one stands in whatever a rule matches, in lower case.
STEMS = [
    ("apartarse",), ("apart",), ("abandonar", "dejar", "revisar"), ("compatible",), ("modificar", "rectificar", "variar"), ("comparte",),
    ("resuelta",), ("resuelto", "decidido"), ("doctrina",), ("conform", "arreglo"), ("sentido",), ("tribunal", "corte"),
    ("doctrina",), ("aplicar",), ("aplicaci", "aplicable"), ("precedente",), ("doctrina",), ("doctrina",),
    ("aplicable",), ("diferencia", "analog", "circunstancias"), ("limitar", "circunscribir", "restringir", "acotar"), ("aplicable",), ("aplicable",), ("objetable", "criticable", "objeto"),
]
# Letters that match an i, s or k in any case, and that lower() doesn't fold to it.
ODD_CASE = "[İıſ\u212a]"
NEGATOR = r"\b(?:no|nunca|jam[áa]s|tampoco|sin\s+que\s+corresponda)\s+(?:\w+\s+){0,3}$"
RECITAL = r"""^\W{0,4}(?:as[íi]\s+|y\s+|luego\s+|despu[ée]s\s+|posteriormente\s+){0,2}(?:en\s+\d{4}\s*,?\s+)?en\s+(?:el\s+)?(?:caso\s+|precedente\s+|autos\s+|re\s+|la\s+causa\s+)?["“'«]"""
APPROVING = r"(?:\bconf\.|\bcfr\.|\bconforme\b|\barg\.|\bv[ée]ase\b|\bcon\s+cita\s+de\b|\ben\s+igual\s+sentido\b|[(\[{]\s*doctrina\s+de\b)[^.;]{0,20}$"
ATTRIBUTION = r"\b(?:el\s+)?(?:recurrente|apelante|actor|demandad[oa]|quejoso|a\s+juicio\s+del\s+procurador|el\s+procurador|(?:sostiene|alega|invoca|afirma|aduce|argumenta)\s+(?:el|la|que\s+el))\b"
CLAUSE_END = r"(?:;|\.(?=\s*[A-ZÁÉÍÓÚÑ0-9])|\sy\s+en\s|\spero\s|\ssin\s+embargo\s|\sno\s+obstante\s|\smientras\s+que\s)"
SOFT_PERIOD = r"\.(?=\s*[a-záéíóúñü])"
CLAUSE_REACH, APPROVING_REACH, ATTRIBUTED = 260, 48, 0.40


class Reading(NamedTuple):
    treatment: str
    confidence: float
    rule: str | None
    scope: str


READING = T.StructType([T.StructField("treatment", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("rule", T.StringType()), T.StructField("scope", T.StringType())])
UNREAD = Reading("mentioned", FALLBACK_CONFIDENCE, None, "fallback")


@lru_cache(maxsize=64)
def _pattern(source: str, flags: int = re.IGNORECASE) -> re.Pattern:
    return re.compile(source, flags)


def clause_around(text: str, position: int) -> str:
    """The stretch between the clause ends next to a position."""
    low, high = max(0, position - CLAUSE_REACH), min(len(text), position + CLAUSE_REACH)
    ends = _pattern(CLAUSE_END)
    cuts = [m.end() for m in ends.finditer(text, low, position)]
    stop = ends.search(text, position, high)
    return text[cuts[-1] if cuts else low : stop.start() if stop else high].strip()


def strongest(text: str) -> tuple | None:
    """The rule of highest confidence that fires, the earlier of equal ones.

    Only the first hit of a rule counts, and not if a negation stands before it
    (unless the rule's own words negate).
    """
    hits, folded, odd = [], text.lower(), _pattern(ODD_CASE, 0).search(text)
    for place, rule in enumerate(RULES):
        if not odd and not any(stem in folded for stem in STEMS[place]):
            continue
        hit = _pattern(rule[4]).search(text)
        if hit and (rule[1] in SELF_NEGATING or not _pattern(NEGATOR).search(text[: hit.start()])):
            hits.append((-rule[2], place))
    return RULES[min(hits)[1]] if hits else None


def read_passage(quote: str | None, position: int | None = None, model: Callable[[str], Reading | None] | None = None) -> Reading:
    """Read one passage; ``position`` is where in it the citation stands.

    ``model`` may be any callable; it is asked only if no rule applies.
    """
    if not (quote or "").strip():
        return UNREAD
    text = _pattern(SOFT_PERIOD, 0).sub(",", quote)
    scope, where = ("whole", text) if position is None else ("clause", clause_around(text, position))
    rule = strongest(where)
    if rule is None and scope == "clause":
        scope, where = "passage", text
        rule = strongest(text)
        if rule is not None and rule[0] == "abandoned":
            rule = None  # a departure has to be stated where the citation is
    if rule is None:
        return (model(quote) if model else None) or UNREAD
    treatment, name, near, far, _ = rule
    confidence = far if scope == "passage" else near
    if _pattern(RECITAL).match(where):
        return Reading("mentioned", FALLBACK_CONFIDENCE, f"{name}(relato-historico)", scope)
    if scope == "clause" and TREATMENTS[treatment][0] in ("negative", "cautionary") and _pattern(APPROVING).search(text[max(0, position - APPROVING_REACH) : position]):
        return Reading("mentioned", FALLBACK_CONFIDENCE, f"{name}(cita-de-apoyo)", scope)
    if _pattern(ATTRIBUTION).search(where):
        return Reading("mentioned", min(confidence, ATTRIBUTED), f"{name}(atribuido)", scope)
    return Reading(treatment, confidence, name, scope)


@F.pandas_udf(READING)
def classify(quote: pd.Series, position: pd.Series) -> pd.DataFrame:
    rows = [read_passage(q, None if pd.isna(p) else int(p)) for q, p in zip(quote, position, strict=True)]
    return pd.DataFrame(rows, columns=Reading._fields)


def _loosened(pattern: str) -> str:
    """A pattern that also matches whatever ``pattern`` matches in a part of a text:
    without word bounds and negative conditions, which a cut can change."""
    out, at = [], 0
    while at < len(pattern):
        if pattern.startswith("(?!", at):
            depth = 0
            while True:
                depth += {"(": 1, ")": -1}.get(pattern[at], 0)
                at += 1
                if not depth:
                    break
        elif pattern.startswith(r"\b", at):
            at += 2
        else:
            out.append(pattern[at])
            at += 1
    return "".join(out)


#: One alternation of all rules, for Spark's own matcher.
ANY_RULE = "(?iU)" + "|".join(f"(?:{_loosened(rule[4])})" for rule in RULES)


def may_be_read(quote: Column) -> Column:
    """False only for passages that no rule can read, wherever the citation stands."""
    return F.coalesce(F.rlike(F.regexp_replace(quote, "(?U)" + SOFT_PERIOD, ","), F.lit(ANY_RULE)), F.lit(False))


def read_passages(passages: DataFrame, quote: str, position: Column, name: str = "r") -> DataFrame:
    """Add the readings of all passages.  Those that no rule can read, the most by
    far, are told apart in the JVM; only the others reach Python."""
    may = may_be_read(F.col(quote))
    read = passages.where(may).withColumn(name, classify(F.col(quote), position.cast("int")))
    fallback = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(UNREAD, READING, strict=True)])
    return read.unionByName(passages.where(~may).withColumn(name, fallback))


def reclassify(citations: DataFrame, position: Column, every: bool = False) -> DataFrame:
    """Edges read anew, with ``changed``: placeholder quotes and manual readings
    stay as they are, and so do readings above the floor unless ``every``."""
    due = ~is_placeholder(F.col("quote")) & (F.col("method") != "manual")
    if not every:
        due = due & (F.col("confidence") <= 0.25)
    # split first: Python would otherwise see the rows that need no reading
    again = read_passages(citations.where(due), "quote", position, "_r")
    changed = (F.col("_r.treatment") != F.col("treatment")) | (F.col("_r.confidence") != F.col("confidence"))
    again = again.withColumn("changed", changed).withColumns({"treatment": F.col("_r.treatment"), "confidence": F.col("_r.confidence"), "method": F.lit("rule")}).drop("_r")
    return again.unionByName(citations.where(~F.coalesce(due, F.lit(False))).withColumn("changed", F.lit(False)))


def grounded(treatment: Column, confidence: Column, evidence: Column, passage: Column) -> Column:
    """A model's verdict as a reading: null unless its evidence stands in the
    passage word for word (blanks and case aside), and never above the ceiling."""
    flat = lambda x: F.lower(F.regexp_replace(F.btrim(x), r"(?U)\s+", " "))
    stands = (F.length(F.btrim(evidence)) > 0) & F.contains(flat(passage), flat(evidence)) & treatment.isin(*TREATMENTS)
    capped = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(MODEL_CEILING))
    return F.when(stands, F.struct(treatment.alias("treatment"), capped.alias("confidence"), F.lit("llm").alias("method")))
