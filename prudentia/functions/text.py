"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prudentia.schema import MAX_PAGE, MAX_VOLUME, QUALITY_FLOOR

# Letters with marks and what they fold to.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
_FOLDED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"

# Patterns of the documents' and captions' conventions.
_RULING = r"(?i)^(?:fallos\s*:?\s*)?(\d{1,3})\s*:\s*(\d{1,%d})$"
_MODERN = r"^([A-Z]{2,4})\s*(\d{3,7})\s*/\s*(\d{4})(?:\s*/\s*([A-Z0-9]{2,8}))?$"
_CLASSIC = r"^([A-Z])\.?\s*(\d{1,4})\.?\s*([IVXLCDM]{1,8})\.?(?:\s*([A-Z]{2,4})\.?)?$"
_ROMAN = r"^[IVXLCDM]{1,8}\.?$"
_NOISE = r"(?iU)(?:\bs/|\bc/|\by\s+otros?\b|\by\s+otras?\b|\bs\.?a\.?\b|\bs\.?r\.?l\.?\b|\bcausa\s+n[°º]?\s*\d+\b|\brecurso\s+de\s+hecho\b|\bexpte\.?)"
_INNER = r"""[A-Za-zÁÉÍÓÚÑÜáéíóúñü.,;:()«»"'\-]"""
_VOWEL = r"[aeiouáéíóúAEIOUÁÉÍÓÚ]"
# a whole token of two or more such characters, the first a letter, with a vowel
_WORDLIKE = rf"(?U)(?<!\S)(?={_INNER}*?{_VOWEL})[A-Za-zÁÉÍÓÚÑÜáéíóúñü]{_INNER}++(?!\S)"
_CITING_LINK = r">\s*Fallos:\s*(\d{1,3}):(\d{1,%d})\s*<"


def _collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def ruling_key(volume: Column, page: Column, last_page: int = MAX_PAGE) -> Column:
    """The id of a position in range, else null."""
    good = volume.between(1, MAX_VOLUME) & page.between(1, last_page)
    return F.when(good, F.concat(F.lit("fallos:"), volume.cast("string"), F.lit(":"), page.cast("string")))


def parse_ruling_id(raw: Column, last_page: int = MAX_PAGE) -> Column:
    """``Fallos: 332:1963`` or ``332:1963`` as an id, the whole text or null."""
    text = F.btrim(raw)
    number = lambda k: F.regexp_extract(text, _RULING % len(str(last_page)), k).try_cast("int")
    return ruling_key(number(1), number(2), last_page)


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.translate(F.regexp_replace(text, r"\p{Mn}", ""), _MARKED, _FOLDED)


def normalize_caption(raw: Column) -> Column:
    """A caption as a lookup key: upper case, no marks, boilerplate or
    punctuation."""
    upper = F.upper(strip_accents(raw))
    return _collapsed(F.regexp_replace(F.regexp_replace(upper, _NOISE, " "), r"(?U)[^\w\s]", " "))


def short_name_key(raw: Column) -> Column:
    return normalize_caption(F.btrim(F.btrim(raw), F.lit("\"'“”")))


def normalize_docket(raw: Column) -> Column:
    """A docket number as a key: ``A.891.XLIV`` or ``CSJ.1086/2022/CS001``;
    null for anything else, a lone roman numeral included."""
    text = _collapsed(raw)
    m = lambda k: F.regexp_extract(text, _MODERN, k)
    c = lambda k: F.regexp_extract(text, _CLASSIC, k)
    plain = lambda x: x.try_cast("int").cast("string")
    modern = F.concat(m(1), F.lit("."), plain(m(2)), F.lit("/"), m(3), F.when(m(4) != "", F.concat(F.lit("/"), m(4))).otherwise(""))
    classic = F.concat(c(1), F.lit("."), plain(c(2)), F.lit("."), c(3))
    return F.when((text == "") | text.rlike(_ROMAN), F.lit(None)).when(text.rlike(_MODERN), modern).when(text.rlike(_CLASSIC), classic)


def clean_text(raw: Column) -> Column:
    """Extracted text with words rejoined at U+FFFE, plain line ends, single
    blanks, stripped lines and at most one empty line in a row."""
    text = F.regexp_replace(F.translate(raw, "￾", ""), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?mU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def join_page_breaks(text: Column) -> Column:
    """Text without page furniture; words cut by it are whole again."""
    # texts without furniture are told by a look for it, and a number's first dash
    # is looked for before what stands around it
    out = F.when(text.contains("-//-"), F.regexp_replace(F.regexp_replace(text, r"(?s)-//-.{0,400}?-//-", ""), "-//-", "")).otherwise(text)
    out = F.regexp_replace(out, r"(?U)-(?<!\w-)\d{1,4}-(?!\w)", " ")
    return F.regexp_replace(out, r"[ \t]{2,}", " ")


def text_quality(text: Column) -> Column:
    """The share of blank-separated tokens that look like words; 0 for none.
    Both are counted in the text: nothing is asked of tokens one by one."""
    ends = F.array(text == "", F.substring(text, 1, 1).rlike(r"(?U)\s"), F.substring(text, -1, 1).rlike(r"(?U)\s"))
    tokens = F.size(F.split(text, r"(?U)\s+")) - F.size(F.array_remove(ends, False))  # less the empty parts
    return F.when(tokens > 0, F.regexp_count(text, F.lit(_WORDLIKE)) / tokens).otherwise(F.lit(0.0))


def text_status(text: Column, floor: float = QUALITY_FLOOR, quality: Column | None = None) -> Column:
    """What the quality gate says of an extracted text, of which ``quality`` may be
    known."""
    blank = F.coalesce(text.rlike(r"(?U)^\s*$"), F.lit(True))
    quality = text_quality(text) if quality is None else quality
    return F.when(blank, "unavailable").when(quality >= floor, "extracted").otherwise("garbled")


def strip_html(value: Column) -> Column:
    return F.coalesce(_collapsed(F.regexp_replace(value, "<[^>]+>", " ")), F.lit(""))


def parse_citing(html: Column, last_page: int = MAX_PAGE) -> Column:
    """Ids of the rulings that a list of links names, each once, in order."""
    link = F.lit(_CITING_LINK % len(str(last_page)))
    pairs = F.arrays_zip(F.regexp_extract_all(html, link, 1).alias("v"), F.regexp_extract_all(html, link, 2).alias("p"))
    ids = F.transform(pairs, lambda x: ruling_key(x["v"].cast("int"), x["p"].cast("int"), last_page))
    return F.coalesce(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def trim_quote(quote: Column, most: int = 320) -> Column:
    flat = _collapsed(quote)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def render_quote(quote: Column, most: int = 1200) -> Column:
    """A passage that can stand in a report without taking it over."""
    flat = _collapsed(quote)
    cut = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("… [pasaje recortado]"))).otherwise(flat)
    return F.concat(F.lit("> "), F.translate(cut, "`>", "'›"))


def when_decided(decided_on: Column, year: Column) -> Column:
    return F.coalesce(decided_on, F.when(year > 0, year.cast("string")), F.lit("fecha desconocida"))


def fold(text: Column) -> Column:
    """Lower-case words of the letters a to z."""
    plain = F.regexp_replace(strip_accents(F.lower(text)), r"\d+", " ")
    return F.array_join(F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0)), " ")
