"""Mining recurrent phrases: n-grams around the words that carry a treatment.

Phrases are counted by 64-bit hashes first: tasks send a row of two numbers for each
phrase of a stretch of passages, and only of words frequent enough.  Those whose hash is
among the most frequent are made as strings, and these are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prudentia.functions.spans import citations_in
from prudentia.functions.text import fold
from prudentia.functions.treatment import clause_around
from prudentia.schema import UNREAD_CEILING, is_placeholder
from prudentia.sources.shared import new_dir

# Words that no phrase begins or ends with, and stems of which a
# reported phrase has one.
EDGE_WORDS = [
    "de", "del", "la", "el", "los", "las", "y", "e", "o", "u", "a", "al", "en", "que", "por", "con", "un",
    "una", "su", "sus", "se", "lo", "es",
]
STEMS = [
    "aplic", "segu", "sigu", "remit", "apart", "abandon", "reiter", "sostuv", "sostien", "resolv", "resuelt",
    "decid", "declar", "confirm", "revoc", "compart", "coincid", "invoc", "recuerd", "senal", "expres",
    "establec", "sento", "sentad", "distingu", "difier", "limit", "restring", "critic", "objet", "analog",
    "doctrin", "criteri", "precedent", "jurisprud", "conform", "arregl", "corresponde", "cabe", "procede",
]
LEAST_WORDS, MOST_WORDS = 2, 6
#: Words before a citation that its phrases are taken from.
WINDOW = 8


@F.pandas_udf(T.StringType())
def _before(quote: pd.Series, cited: pd.Series) -> pd.Series:
    """What stands in the citation's own clause before it; null where the passage
    doesn't hold the citation."""

    def one(text: str | None, ident: str | None) -> str | None:
        at = next((start for _, start, _, v, p in citations_in(text or "") if f"fallos:{v}:{p}" == ident), None)
        if at is None:
            return None
        clause = clause_around(text, at)
        stands = clause.find(text[at : at + 8])
        return clause[:stands] if stands > 0 else clause

    return pd.Series([one(q, c) for q, c in zip(quote, cited, strict=True)], dtype=object)


def left_window(quote: Column, cited: Column) -> Column:
    """The last eight words, folded, before a citation within its clause."""
    words = F.filter(F.split(fold(_before(quote, cited)), " "), lambda w: w != "")
    return F.slice(words, F.greatest(F.size(words) - (WINDOW - 1), F.lit(1)), WINDOW)


def unread_windows(citations: DataFrame) -> DataFrame:
    """(citing_id, cited_id, words): the windows of the passages that no rule could
    read.  Passages that don't hold their citation have none."""
    place = F.concat(F.lit("(?U)"), F.element_at(F.split("cited_id", ":"), 2), F.lit(r"\s*:\s*"), F.element_at(F.split("cited_id", ":"), 3))
    due = (F.col("confidence") <= UNREAD_CEILING) & ~is_placeholder(F.col("quote")) & F.rlike("quote", place)
    return citations.where(due).select("citing_id", "cited_id", left_window(F.col("quote"), F.col("cited_id")).alias("words")).where("words IS NOT NULL")


def frequent_words(passages: DataFrame, words: str, most: int) -> tuple[list[str] | None, int]:
    """The ``most`` words that most passages hold, and in how many the next one is;
    (None, 0) if there are no more words than that."""
    each = passages.select(F.explode(F.array_distinct(words)).alias("w")).where("w IS NOT NULL")
    top = each.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most + 1).collect()
    return ([r["w"] for r in top[:most]], top[most]["n"]) if len(top) > most else (None, 0)


#: Words that a task counts the phrases of at once.
STRETCH = 1 << 18
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _chained(number: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a number behind what has the hash ``seed``."""
    turned = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    h = seed + _P5 + np.uint64(8) ^ turned(number * _P2, 31) * _P1
    h = turned(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _marks(stems: list[str] | None) -> tuple:
    """Whether a word is an edge word, and whether it carries a stem."""
    carries = (lambda w: F.lit(True)) if stems == [""] else (lambda w: w.rlike("|".join(stems or STEMS)))
    return (lambda w: w.isin(EDGE_WORDS)), carries


def _code(word: Column, edge: Column, stem: Column) -> Column:
    """A word's hash, whose lowest bits are its marks."""
    return F.xxhash64(word).bitwiseAND(F.lit(-4)).bitwiseOR(F.when(edge, 1).otherwise(0).cast("long")).bitwiseOR(F.when(stem, 2).otherwise(0).cast("long"))


def phrase_counts(passages: DataFrame, words: str, stems: list[str] | None, kept: list[str] | None = None) -> DataFrame:
    """(h, n): in how many passages each phrase occurs, by the hash of its words'
    codes.  What a phrase is, see :func:`starts`."""
    edge, carries = _marks(stems)
    codes = F.transform(words, lambda w: F.when(w.isNotNull() if kept is None else w.isin(kept), _code(w, edge(w), carries(w))))

    def stretches(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, known, passage) of whole passages, about ``STRETCH`` words."""
        for batch in batches:
            lists = batch.column("codes")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            code, ends = flat.fill_null(0).to_numpy().view(np.uint64), np.cumsum(sizes)
            row, at = 0, 0
            while row < len(sizes):
                to = max(row + 1, int(np.searchsorted(ends, at + STRETCH, "right")))
                end = int(ends[to - 1])
                yield code[at:end], known[at:end], np.repeat(np.arange(to - row), sizes[row:to])
                row, at = to, end

    def run(batches) -> Iterator[pa.RecordBatch]:
        for code, known, passage in stretches(batches):
            edge, stem = (code & np.uint64(1)).astype(bool), (code & np.uint64(2)).astype(bool)
            at = np.flatnonzero(known & ~edge)
            h, has = _chained(code[at], np.full(len(at), 42, np.uint64)), stem[at]
            hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for k in range(1, MOST_WORDS):
                inside = at + k < len(code)
                at, h, has = at[inside], h[inside], has[inside]
                goes_on = known[at + k] & (passage[at + k] == passage[at])
                at, h, has = at[goes_on], h[goes_on], has[goes_on]
                h, has = _chained(code[at + k], h), has | stem[at + k]
                whole = has & ~edge[at + k]
                hashes.append(h[whole])
                owners.append(passage[at[whole]])
            every, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.lexsort((owner, every))
            every, owner = every[order], owner[order]
            new = np.ones(len(every), dtype=bool)
            new[1:] = every[1:] != every[:-1]
            once = new.copy()
            once[1:] |= owner[1:] != owner[:-1]
            first = np.flatnonzero(new)
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(every[first].view(np.int64)), pa.array(np.add.reduceat(once.astype(np.int64), first))], ["h", "n"])

    return passages.select(codes.alias("codes")).where(F.size("codes") >= LEAST_WORDS).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def starts(passages: DataFrame, words: str, stems: list[str] | None, kept: list[str] | None = None) -> DataFrame:
    """(passage, w1, ..., w6): each word that may begin a phrase with those behind
    it, each marked as an edge word and as carrying a stem; null for words that
    aren't ``kept``.

    An n-gram without the edge words at its ends is a shorter n-gram that begins
    and ends with other words, so phrases between words that are none are all that
    n-grams give; a phrase has a stem if one of its words has.
    """
    edge, carries = _marks(stems)
    one = lambda w: F.struct(w.alias("w"), edge(w).alias("edge"), carries(w).alias("stem"), _code(w, edge(w), carries(w)).alias("code"))
    marked = F.transform(words, lambda w: F.when(w.isNotNull() if kept is None else w.isin(kept), one(w)))
    numbered = passages.select(F.monotonically_increasing_id().alias("passage"), marked.alias("m")).where(F.size("m") >= LEAST_WORDS)
    size = F.size("m")
    behind = [F.slice("m", F.lit(k), F.greatest(size - (k - 1), F.lit(0))).alias(f"w{k}") for k in range(2, MOST_WORDS + 1)]
    rows = numbered.select("passage", F.explode(F.arrays_zip(F.col("m").alias("w1"), *behind)).alias("s")).select("passage", "s.*")
    return rows.where("w1 IS NOT NULL AND NOT w1.edge AND w2 IS NOT NULL")


def _phrases(made) -> Column:
    """``made(columns)`` of each phrase that begins at w1."""
    out, whole, stem = [], F.col("w1").isNotNull(), F.col("w1")["stem"]
    for k in range(2, MOST_WORDS + 1):
        last = F.col(f"w{k}")
        whole, stem = whole & last.isNotNull(), stem | last["stem"]
        out.append(F.when(whole & ~last["edge"] & stem, made([F.col(f"w{j}") for j in range(1, k + 1)])))
    return F.array(*out)


#: How many words phrases are first made of.
VOCABULARY = (1_024, 16_384)


def mine(passages: DataFrame, words: str, least: int, top: int, stems: list[str] | None = None) -> DataFrame:
    """(gram, n): in how many passages a phrase of 2 to 6 words occurs that neither
    begins nor ends with an edge word and has a stem: the most frequent, of those
    in ``least`` passages at least.  Ties by the phrase.  ``stems`` are patterns; an
    empty one takes every phrase.  Null arrays and shorter ones have none.

    A phrase is in no more passages than its rarest word.  So phrases are first made
    of the most frequent words only; if the last of the best is in more passages
    than any word left out, no other phrase can be among them.  Else more words
    are let in, and at last all.
    """
    spark = passages.sparkSession
    for most in (*VOCABULARY, None):
        kept, bound = frequent_words(passages, words, most) if most else (None, 0)
        folder = new_dir(spark, "phrases")
        phrase_counts(passages, words, stems, kept).where(F.col("n") >= max(least, bound)).write.parquet(folder)  # read twice, made once
        counts = spark.read.schema("h long, n long").parquet(folder)
        last, rows = counts.orderBy(F.desc("n")).limit(top).agg(F.min("n"), F.count("*")).first()
        if kept is None or rows == top and last > bound:
            break
    if last is None:
        return spark.createDataFrame([], "gram string, n long")
    best = counts.where(F.col("n") >= last).select("h")
    begun = starts(passages, words, stems, kept)
    each = begun.select("passage", F.explode(_phrases(lambda ws: F.struct(F.xxhash64(*[w["code"] for w in ws]).alias("h"), F.concat_ws(" ", *[w["w"] for w in ws]).alias("gram")))).alias("g")).where("g IS NOT NULL")
    grams = each.select("passage", "g.*").join(best, "h", "left_semi").select("passage", "gram").distinct()
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return found.orderBy(F.desc("n"), "gram").limit(top)
