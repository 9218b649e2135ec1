"""The citation graph: tables, enumerations and constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabulary that stored graphs use.
TREATMENTS = {  # treatment: (polarity, severity, label)
    "applied": ("positive", 0, "aplicado"),
    "followed": ("positive", 0, "seguido"),
    "mentioned": ("neutral", 1, "mencionado"),
    "distinguished": ("cautionary", 2, "distinguido"),
    "limited": ("cautionary", 3, "limitado"),
    "criticized": ("cautionary", 4, "criticado"),
    "abandoned": ("negative", 5, "abandonado"),
}
OPINIONS = {
    "majority": "mayoria",
    "concurrence": "voto propio",
    "dissent": "disidencia",
    "partial_dissent": "disidencia parcial",
    "dictamen": "dictamen del Procurador",
    "unknown": "indeterminado",
}
METHODS = ("rule", "llm", "manual")
TEXT_STATUSES = ("extracted", "ocr", "garbled", "unavailable")
FORMS = ("fallos", "expediente", "short_name", "caption")
ALIAS_SOURCES = ("csjn", "manual")
SIGNALS = {
    "red": "doctrina abandonada",
    "green": "doctrina vigente",
    "yellow": "vigente con reservas",
    "gray": "sin tratamiento registrado",
}
NEGATIVE_FLOOR = 0.75
UNREAD_CEILING = 0.25
FALLBACK_CONFIDENCE = 0.20
GRAY_CEILING = 0.5
QUALITY_FLOOR = 0.70
MODEL_CEILING = 0.70
MAX_EVIDENCE, MAX_STEPS, MAX_DEPTH = 10, 40, 6
DEFAULT_LIMIT, MAX_LIMIT, MAX_QUERY = 20, 100, 300
MAX_VOLUME, MAX_PAGE = 500, 9999
#: The bound where a page isn't read out of a text, but looked up or stated as a number.
ANY_PAGE = 999_999_999
PLACEHOLDER_QUOTE = "Referencia publicada por la CSJN"

RULINGS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("volume", T.IntegerType(), False),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("caption", T.StringType(), False),
        T.StructField("short_name", T.StringType()),
        T.StructField("decided_on", T.StringType()),
        T.StructField("decided_year", T.IntegerType(), False),
        T.StructField("source_url", T.StringType(), False),
        T.StructField("text_status", T.StringType(), False),
        T.StructField("text_quality", T.DoubleType()),
        T.StructField("csjn_doc_id", T.LongType()),
    ]
)
CITATIONS = T.StructType(
    [
        T.StructField("citing_id", T.StringType(), False),
        T.StructField("cited_id", T.StringType(), False),
        T.StructField("treatment", T.StringType(), False),
        T.StructField("opinion", T.StringType(), False),
        T.StructField("confidence", T.DoubleType(), False),
        T.StructField("quote", T.StringType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("sumario_id", T.LongType()),
    ]
)
ALIASES = T.StructType([T.StructField(c, T.StringType(), False) for c in ("raw", "ruling_id", "form", "source")])


def polarity(treatment: str | Column = "treatment") -> Column:
    return _looked_up(treatment, 0)


def severity(treatment: str | Column = "treatment") -> Column:
    return _looked_up(treatment, 1)


def label(treatment: str | Column = "treatment") -> Column:
    return _looked_up(treatment, 2)


def _looked_up(treatment: str | Column, place: int) -> Column:
    column = F.col(treatment) if isinstance(treatment, str) else treatment
    out = F.when(F.lit(False), F.lit(None))
    for name, row in TREATMENTS.items():
        out = out.when(column == name, F.lit(row[place]))
    return out


def is_placeholder(quote: Column) -> Column:
    """Whether a quote stands for an edge without a passage, in whatever case."""
    return F.lower(quote).startswith(PLACEHOLDER_QUOTE.lower())


def binding(opinion: str = "opinion") -> Column:
    """Only the majority's treatment binds."""
    return F.coalesce(F.col(opinion) == "majority", F.lit(False))
