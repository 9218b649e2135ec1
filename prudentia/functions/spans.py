"""Citations in the text of a ruling: where, in whose opinion, in what passage.

Spark's regular expressions give no offsets, so one Arrow function per document
finds the citations, the opinions and the quotes in a single pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prudentia.functions.text import join_page_breaks
from prudentia.functions.treatment import READING, read_passage
from prudentia.schema import MAX_PAGE, MAX_VOLUME

# What marks citations and the headings of opinions.
MARKER = r"[Ff](?i:allos)\s*:?\s*(?=\d)"  # of a set of characters, which the scan looks for first
REFERENCE = r"(\d{1,3})\s*:\s*(\d{1,4})"
FOLLOWING = r"\s*(?:,|;|\sy\s|\se\s)\s*(\d{1,4}(?:\s*:\s*\d{1,4})?)"
HEADING = r"(?P<title>VOTO|DISIDENCIA\s+PARCIAL|DISIDENCIA)\s+(?:DE\s+L[AO]S?|DEL|DE)\s+(?:SEÑOR(?:A|ES)?|SEÑORAS?)\s+(?:PRESIDENTE|VICEPRESIDENTE|MINISTR[OA]S?|JUE[CZ]E?S?)(?P<names>.{0,180}?)Considerando"
DICTAMEN = r"DICTAMEN\s+DEL\s+PROCURADOR\s+(?:GENERAL|FISCAL)[^\n]{0,120}"
COURT = r"(?:FALLO\s+DE\s+LA\s+CORTE\s+SUPREMA|Buenos\s+Aires,\s+\d{1,2}\s+de\s+\w+\s+de\s+(?:19|20)\d\d\s*\.?\s*Vistos)"
TITLE = r"^(?:DOCTOR(?:A|ES|AS)?\s+)?(?:DO[ÑN]A?\s+)?"
SENTENCE = r"(?<=[.;:])\s+(?=[A-ZÁÉÍÓÚÑ0-9])"
STOP = r"[.;]"
OPINION_OF = {"VOTO": "concurrence", "DISIDENCIA": "dissent", "DISIDENCIA PARCIAL": "partial_dissent"}
BEFORE, AFTER, OPENING, TAIL = 320, 200, 180, 160

_I, _IS = re.IGNORECASE, re.IGNORECASE | re.DOTALL
_marker = re.compile(MARKER)
_reference, _following = (re.compile(p, _I) for p in (REFERENCE, FOLLOWING))
_sentence, _stop = re.compile(SENTENCE), re.compile(STOP)
_title = re.compile(TITLE, _I)
# every heading's first word, cheap to look for; what follows is tried there only
_opening = re.compile(r"[VvDdFfBb](?i:oto|isidencia|ictamen|allo|uenos)")
_turn = re.compile("|".join(f"(?=(?P<{kind}>{pattern}))" for kind, pattern in (("vote", HEADING), ("dictamen", DICTAMEN), ("court", COURT))), _IS)


def citations_in(text: str) -> list[tuple[str, int, int, int, int]]:
    """(raw, start, end, volume, page) of every reference after a marker.

    A marker opens a run of references; bare numbers in it are pages within the
    ruling before and are passed over, as are positions out of range.
    """
    out, at = [], 0
    while marker := _marker.search(text, at):
        at = marker.end()
        ref = _reference.match(text, at)
        if not ref:
            continue
        while True:
            if ref:
                volume, page = int(ref[1]), int(ref[2])
                if 1 <= volume <= MAX_VOLUME and 1 <= page <= MAX_PAGE:
                    out.append((ref[0], ref.start(), ref.end(), volume, page))
                at = ref.end()
            more = _following.match(text, at)
            if not more:
                break
            ref = _reference.fullmatch(text, more.start(1), more.end(1))
            at = more.end()
    return out


def turns(text: str) -> Iterator[tuple[int, str, str]]:
    """(offset, opinion, author) wherever another opinion begins, in order.

    One scan: each offset with a heading's first word is looked at for all kinds of
    headings; a heading that runs on hides others of its own kind inside it, and none of another kind.
    """
    ends: dict[str, int] = {}
    for opening in _opening.finditer(text):
        found = _turn.match(text, opening.start())
        if not found:
            continue
        kind, offset = found.lastgroup, found.start()
        if offset < ends.get(kind, 0):
            continue
        ends[kind] = found.end(kind)
        if kind == "court":
            yield offset, "majority", ""
        elif kind == "dictamen":
            yield offset, "dictamen", "Procurador General"
        else:
            title, names = (" ".join(found[k].split()) for k in ("title", "names"))
            yield offset, OPINION_OF.get(title.upper(), "unknown"), _title.sub("", names).strip(" .,-")


def attributed(text: str) -> Iterator[tuple[tuple[str, int, int, int, int], str, str]]:
    """Each citation with the opinion that is speaking and its author: until a first
    heading the majority, then whoever began last."""
    coming, opinion, author = turns(text), "majority", ""
    turn = next(coming, None)
    for cited in citations_in(text):
        while turn and turn[0] <= cited[1]:
            _, opinion, author = turn
            turn = next(coming, None)
        yield cited, opinion, author


def passage_of(text: str, start: int, end: int) -> tuple[str, int | None]:
    """The passage around a citation, blanks collapsed, and where in it the
    citation stands (None if what is left doesn't reach to it).  Where the window
    cuts the text, it shrinks to the sentence that begins within ``OPENING``
    characters and to the last stop among the ``TAIL`` at the end."""
    passage = " ".join(text[max(0, start - BEFORE) : end + AFTER].split())
    # an x in the citation's place keeps the blank before it
    place = len(" ".join((text[max(0, start - BEFORE) : start] + "x").split())) - 1
    first, last = 0, len(passage)
    if start > BEFORE and (begun := _sentence.search(passage, 0, OPENING)):
        first = begun.end()
    if end + AFTER < len(text):
        last = max((m.end() for m in _stop.finditer(passage, max(first, last - TAIL))), default=last)
    return passage[first:last].strip(), place - first if first <= place < last else None


def quote_of(text: str, start: int, end: int) -> str:
    """The passage around a citation, see :func:`passage_of`."""
    return passage_of(text, start, end)[0]


FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("raw", T.StringType()),
            T.StructField("offset", T.IntegerType()),
            T.StructField("volume", T.IntegerType()),
            T.StructField("page", T.IntegerType()),
            T.StructField("quote", T.StringType()),
            T.StructField("opinion", T.StringType()),
            T.StructField("author", T.StringType()),
            T.StructField("reading", READING),
        ]
    )
)


@F.pandas_udf(FOUND)
def scan(text: pd.Series) -> pd.Series:
    """All citations of each text, with opinion, quote and reading."""

    def one(whole: str | None) -> list[tuple]:
        if not whole:
            return []
        out = []
        for (raw, start, end, volume, page), opinion, author in attributed(whole):
            quote, place = passage_of(whole, start, end)
            if quote:
                out.append((raw, start, volume, page, quote, opinion, author, tuple(read_passage(quote, place))))
        return out

    return text.map(one)


def extract_edges(documents: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """Edges of all documents: page furniture removed, citations found, read
    and attributed; references to the document itself are dropped."""
    return edges_of(documents.select(F.col(ident).alias("citing_id"), found_in(F.col(text)).alias("_found")))


def found_in(text: Column) -> Column:
    """All citations of a text without its page furniture, see :func:`scan`."""
    return scan(join_page_breaks(text))


def cited_id(found: Column) -> Column:
    return F.format_string("fallos:%d:%d", found["volume"], found["page"])


def edges_of(found: DataFrame) -> DataFrame:
    """The edges of documents (``citing_id``) in whose texts ``_found`` was found."""
    rows = found.select("citing_id", F.explode("_found").alias("c"))
    return rows.select("citing_id", cited_id(F.col("c")).alias("cited_id"), "c.reading.treatment", "c.opinion", "c.author", "c.reading.confidence", "c.reading.rule", "c.reading.scope", "c.quote", "c.offset", "c.raw", F.lit("rule").alias("method")).where("citing_id <> cited_id")
