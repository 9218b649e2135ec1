"""Quality rules: text statistics and n-gram perplexity bands per language.

Two language models, both interpolated modified Kneser-Ney of order 3, judge a
text.  The one over words (:mod:`prudentia.llm.word_model`) grows with the
corpus and is kept in partitioned tables.  The one over bytes tells garbled
spelling: Spark counts the n-grams of all documents, each task summing its own
first.  A language's byte model is two sorted arrays of hashes, of n-grams with
their probabilities and of contexts with their back-off weights, of at most
2**24 n-grams, and fits every task.

A document is rejected if its mean bits per byte leave its language's band, or
if its mean bits per word lie above that of words.  Bands are quartiles of all
documents of the language, widened; few bits per word mean a text that comes
again elsewhere, which other stages deal with.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prudentia.llm.storage import aside, new_dir, scratch, written
from prudentia.llm.textscan import SCORING, SubstringHash, chunks, column_bytes, give_back, in_group, met_again, mix, sums, tally, task_cache, words
from prudentia.llm.word_model import doc_keys, word_bits

U64 = np.uint64
ORDER = 3
#: Bytes of scoring tables that a worker keeps; one may be larger.
TABLE_BYTES = 48 << 20
#: Values of the band histograms per bit.
FINE = 200
#: How many interquartile ranges the band reaches beyond the quartiles, below
#: and above, and the slack for short texts: bits times bytes.
BELOW, ABOVE, SHORT = 3.0, 3.0, 40.0
#: The key of a document in the word model's result.
DOC = "_word_model_doc"
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 5


# ---- text statistics ------------------------------------------------------

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(again, first): True for entries whose (group, key) comes more than once,
    and for the first of each; which of equal ones is first is arbitrary."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = mix(keys ^ mix(groups.astype(np.uint64) + U64(1)))
    order = np.argsort(own)
    ranked = own[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    first = np.ones(len(keys), dtype=bool)
    first[order[1:]] = ~same
    return again, first


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base statistics of each text."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    out = {"n_words": count}
    # bytes that continue a code point are no blanks, so all of them are in words
    out["word_chars"] = sums(ends - starts, first) - tally((data & 0xC0) == 0x80, offsets)
    out["n_symbols"] = tally(SYMBOL[data], offsets)
    hashes = SubstringHash(data)
    # lines: they begin with their text or after a line feed
    feeds = np.flatnonzero(data == 0x0A)
    owner_of_feed = np.searchsorted(offsets[:-1], feeds, "right") - 1
    begins = np.concatenate([offsets[:-1], feeds + 1])
    owner = np.concatenate([np.arange(n), owner_of_feed])
    order = np.lexsort((begins, owner))
    begins, owner = begins[order], owner[order]
    stops = np.append(begins[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    stops[last] = offsets[1:][owner[last]]
    wordy = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops, owner = begins[wordy], stops[wordy], owner[wordy]
    _, once = repeated(owner, hashes.strings(begins, stops))
    out["n_dup_lines"] = np.bincount(owner[~once], minlength=n)
    # words in 5-word windows that come twice or more
    word = hashes.strings(starts, ends)
    text = np.repeat(np.arange(n), count)
    covered = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(starts) >= WINDOW:
        whole = text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        gram = np.zeros(len(at), dtype=np.uint64)
        for k in range(WINDOW):
            gram = gram * U64(0xD1342543DE82EF95) + word[at + k]
        again = met_again(mix(gram ^ mix(text[at].astype(np.uint64) + U64(1))))
        covered[at[again]] += 1
        covered[at[again] + WINDOW] -= 1
    out["n_repeat_words"] = sums(np.cumsum(covered[:-1]) > 0, first)
    return out


# ---- n-grams --------------------------------------------------------------


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the three bytes up to it, as a number; zero bytes stand
    before each text."""
    grams = np.zeros(len(data), dtype=np.int32)
    own = data.astype(np.int32)
    grams += own
    grams[1:] += own[:-1] << 8
    grams[2:] += own[:-2] << 16
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    grams[begins] = own[begins]
    second = begins + 1
    second = second[second < len(data)]
    second = second[~np.isin(second, begins)]
    grams[second] = own[second] | own[second - 1] << 8
    return grams


def by_language(languages: list, offsets: np.ndarray) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(language, its texts, its bytes): indices of both."""
    kinds: dict[object, list[int]] = {}
    for i, x in enumerate(languages):
        kinds.setdefault(x, []).append(i)
    for x, texts in kinds.items():
        texts = np.array(texts)
        sizes = np.diff(offsets)[texts]
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield x, texts, np.repeat(offsets[texts], sizes) + inner


def count_ngrams(docs: DataFrame, text: str, language: str) -> DataFrame:
    """(language, gram, n) over all documents; tasks send sums."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: dict[object, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for x, (keys, n) in held.items():
                for a in range(0, len(keys), 100_000):
                    k = keys[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(n[a : a + 100_000], pa.int64())], ["language", "gram", "n"])
            held.clear()

        for part in chunks(batches, text):
            if sum(len(keys) for keys, _ in held.values()) > 4_000_000:  # very many languages
                yield from out()
            data, offsets = column_bytes(part.column(text))
            grams = trigrams(data, offsets)
            for x, _, at in by_language(part.column(language).to_pylist(), offsets):
                keys, n = np.unique(grams[at], return_counts=True)
                if x in held:
                    both, place = np.unique(np.concatenate([held[x][0], keys]), return_inverse=True)
                    total = np.bincount(place, np.concatenate([held[x][1], n]), len(both)).astype(np.int64)
                    keys, n = both, total
                held[x] = keys, n
        yield from out()

    narrow = docs.select(F.col(language).cast("string").alias(language), F.col(text).alias(text))
    return narrow.mapInArrow(count, "language string, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


# ---- modified Kneser-Ney --------------------------------------------------


def discounts(counts: np.ndarray) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and 3 or more, from how many n-grams
    have counts 1 to 4; 0.5, 1 and 1.5 where those tell nothing."""
    n1, n2, n3, n4 = (float(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))])


def gram_hash(order: int, gram: np.ndarray) -> np.ndarray:
    return mix(gram.astype(np.uint64) + (U64(order) << U64(40)))


class Model:
    """Probabilities and back-off weights, each beside a sorted hash array."""

    def __init__(self, keys, probability, contexts, weight):
        self.keys, self.probability, self.contexts, self.weight = keys, probability, contexts, weight

    @classmethod
    def fit(cls, gram: np.ndarray, n: np.ndarray) -> Model:
        """From the counts of all n-grams of order 3 of a language."""
        levels = [(gram.astype(np.int64), n.astype(np.int64))]
        for order in range(ORDER - 1, 0, -1):  # how many different bytes precede
            keys, kinds = np.unique(levels[0][0] & (1 << 8 * order) - 1, return_counts=True)
            levels.insert(0, (keys, kinds))
        lower_keys, lower = np.arange(1), np.full(1, 1 / 256)
        all_keys, all_p, all_contexts, all_weights = [], [], [], []
        for order, (keys, counts) in enumerate(levels, 1):
            cut = discounts(counts)[np.minimum(counts, 3)]
            context, place = np.unique(keys >> 8, return_inverse=True)
            total = np.bincount(place, counts)
            weight = np.bincount(place, cut) / total
            below = lower[np.searchsorted(lower_keys, keys & (1 << 8 * (order - 1)) - 1)] if order > 1 else lower[0]
            p = (counts - cut) / total[place] + weight[place] * below
            all_keys.append(gram_hash(order, keys))
            all_p.append(p)
            all_contexts.append(gram_hash(order, context))
            all_weights.append(weight)
            lower_keys, lower = keys, p
        keys, contexts = np.concatenate(all_keys), np.concatenate(all_contexts)
        a, b = np.argsort(keys), np.argsort(contexts)
        return cls(keys[a], np.concatenate(all_p)[a].astype(np.float32), contexts[b], np.concatenate(all_weights)[b].astype(np.float32))

    @staticmethod
    def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(sorted_keys, wanted), max(0, len(sorted_keys) - 1))
        return place, sorted_keys[place] == wanted if len(sorted_keys) else np.zeros(len(wanted), bool)

    def probabilities(self, gram: np.ndarray) -> np.ndarray:
        """p(last byte | the two before), backing off where needed."""
        gram = gram.astype(np.int64)
        p = np.full(len(gram), 1 / 256)
        for order in range(1, ORDER + 1):
            own = gram & (1 << 8 * order) - 1
            place, seen = self._find(self.contexts, gram_hash(order, own >> 8))
            if len(self.weight):
                p = np.where(seen, p * self.weight[place], p)
            place, seen = self._find(self.keys, gram_hash(order, own))
            if len(self.keys):
                p = np.where(seen, self.probability[place], p)
        return p

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, bits): ``bits[row[context], byte]`` for every context of two
        bytes; contexts never seen share the row of their second byte."""
        contexts = np.arange(1 << 16)
        _, seen = self._find(self.contexts, gram_hash(ORDER, contexts))
        row = np.where(seen, 256 + np.cumsum(seen) - 1, contexts & 255).astype(np.int32)
        rows = [np.arange(256) | 1 << 40, contexts[seen]]  # a first byte that never was: only lower orders count
        base = np.concatenate(rows)
        bits = np.empty((len(base), 256), dtype=np.float32)
        for a in range(0, len(base), 1024):
            part = base[a : a + 1024]
            grams = (part[:, None] << 8 | np.arange(256)).ravel()
            bits[a : a + 1024] = -np.log2(self.probabilities(grams)).reshape(-1, 256)
        return row, bits


_MODEL = T.StructType([T.StructField("language", T.StringType()), *[T.StructField(c, T.BinaryType()) for c in ("keys", "probability", "contexts", "weight")]])


def write_models(counts: DataFrame) -> tuple[str, int]:
    """Fit every language's model and write them below a folder of shared
    storage, one file a language; return the folder and the bytes of all texts."""
    folder = new_dir(counts.sparkSession, "models")

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("gram")
        model = Model.fit(frame["gram"].to_numpy(), frame["n"].to_numpy())
        fs, root = pafs.FileSystem.from_uri(folder)
        row = {"keys": model.keys, "probability": model.probability, "contexts": model.contexts, "weight": model.weight}
        path = f"{root}/{_file_of(key[0])}"
        fs.create_dir(root, recursive=True)
        spare = f"{path}.{np.random.default_rng().integers(1 << 62)}"
        pq.write_table(pa.table({k: pa.array([v.tobytes()], pa.large_binary()) for k, v in row.items()}), spare, filesystem=fs)
        fs.move(spare, path)
        model = row = None
        give_back(SCORING)
        return pd.DataFrame({"language": [key[0]], "bytes": [frame["n"].sum()]})

    fitted = written(counts.groupBy("language").applyInPandas(fit, "language string, bytes long"), "fitted")
    return folder, fitted.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def _file_of(language) -> str:
    return "model-null" if language is None else f"model-of-{quote(str(language), safe='')}"


_tables: OrderedDict[tuple[str, object], tuple[np.ndarray, np.ndarray]] = task_cache(kind=OrderedDict, name=SCORING)


def _table(folder: str, language) -> tuple[np.ndarray, np.ndarray]:
    """A language's scoring table; a worker keeps the last few until a task of
    another stage ends."""
    key = folder, language
    if key not in _tables:
        fs, root = pafs.FileSystem.from_uri(folder)
        row = pq.read_table(f"{root}/{_file_of(language)}", filesystem=fs).to_pylist()[0]
        kinds = {"keys": np.uint64, "probability": np.float32, "contexts": np.uint64, "weight": np.float32}
        made = Model(*(np.frombuffer(row[k], kind) for k, kind in kinds.items())).table()
        while _tables and sum(bits.nbytes for _, bits in _tables.values()) + made[1].nbytes > TABLE_BYTES:
            _tables.popitem(last=False)
        _tables[key] = made
    _tables.move_to_end(key)
    return _tables[key]


# ---- the operator ---------------------------------------------------------


def byte_costs(folder: str, data: np.ndarray, offsets: np.ndarray, languages: list) -> np.ndarray:
    """Bits of each byte under the model of its text's language."""
    grams, cost = trigrams(data, offsets), np.zeros(len(data), dtype=np.float32)
    cuts = [i for i in range(len(languages)) if i == 0 or languages[i] != languages[i - 1]]
    for i, j in zip(cuts, [*cuts[1:], len(languages)], strict=True):  # texts in a row of one language
        a, b = offsets[i], offsets[j]
        if b > a:
            row, bits = _table(folder, languages[i])
            g = grams[a:b]
            np.take(bits.ravel(), (row[g >> 8] << 8) + (g & 255), out=cost[a:b])
    return cost


def spelling_of(folder: str):
    """spelling(data, offsets, languages, begin, end, doc): bits of stretches of
    bytes, each of a text, under the model of its language."""

    def spelling(data: np.ndarray, offsets: np.ndarray, languages: list, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.zeros(len(begin))
        kinds = {x: k for k, x in enumerate(dict.fromkeys(languages))}
        of = np.array([kinds[x] for x in languages], dtype=np.int64)[doc]
        for x, k in kinds.items():
            mine = np.flatnonzero(of == k)
            if not len(mine):
                continue
            row, bits = _table(folder, x)
            size = end[mine] - begin[mine]
            inner = in_group(size)
            place = np.repeat(begin[mine], size) + inner
            at = np.repeat(begin[mine] - offsets[doc[mine]], size) + inner  # in the text
            g = data[place].astype(np.int32)
            g += np.where(at > 0, data[np.maximum(place - 1, 0)], 0).astype(np.int32) << 8
            g += np.where(at > 1, data[np.maximum(place - 2, 0)], 0).astype(np.int32) << 16
            cost = bits.ravel()[(row[g >> 8] << 8) + (g & 255)]
            out[mine] = np.add.reduceat(cost.astype(np.float64), np.cumsum(size) - size)
        return out

    return spelling


def score(docs: DataFrame, folder: str, text: str, language: str, keep_text: bool) -> DataFrame:
    """Add the base statistics, ``n_bytes`` and ``bits`` (mean bits per byte
    under the language's model, null for an empty text), and ``DOC``."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in (*BASE, "n_bytes")], T.StructField("bits", T.DoubleType()), T.StructField(DOC, T.LongType())])
    names = [f.name for f in kept]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, keep=SCORING):
            data, offsets = column_bytes(part.column(text))
            made = statistics(data, offsets)
            languages = part.column(language).cast(pa.string()).to_pylist()
            cost = byte_costs(folder, data, offsets, languages)
            sizes = np.diff(offsets)
            mean = sums(cost.astype(np.float64), offsets) / np.maximum(sizes, 1)
            columns = [*[pa.array(made[c].astype(np.int64)) for c in BASE], pa.array(sizes.astype(np.int64)), pa.array(np.round(mean, 6), mask=sizes == 0), pa.array(doc_keys(data, offsets, languages))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *columns], [*names, *BASE, "n_bytes", "bits", DOC])

    return docs.mapInArrow(run, schema)


def bands(scored: DataFrame, language: str, bits: str = "bits") -> DataFrame:
    """(language, low, high) of ``bits`` from the quartiles of all documents
    that pass the base rules and have bits.

    Values are counted in steps of 1 / ``FINE`` bit, so the quartiles come from
    sums that don't depend on the order in which tasks end.
    """
    steps = scored.where(F.col(bits).isNotNull() & ~F.col("base_failed")).groupBy(F.col(language).cast("string").alias("_language"), F.round(F.col(bits) * FINE).cast("long").alias("step")).agg(F.count("*").alias("n"))

    def cut(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("step")
        step, share = frame["step"].to_numpy() / FINE, np.cumsum(frame["n"].to_numpy()) / frame["n"].sum()
        q1, q3 = (step[min(np.searchsorted(share, q), len(step) - 1)] for q in (0.25, 0.75))
        spread = max(q3 - q1, 2 / FINE)
        return pd.DataFrame({"_language": [key[0]], "low": [q1 - BELOW * spread], "high": [q3 + ABOVE * spread]})

    return written(steps.groupBy("_language").applyInPandas(cut, "_language string, low double, high double"), "bands")


def judge(docs: DataFrame, text: str = "text", language: str = "lang", keep_text: bool = True) -> DataFrame:
    """Add the base statistics, ``bits``, ``word_bits``, ``base_failed`` and
    ``kept``.

    ``base_failed``: fewer than 10 words, or more than a fifth of them in
    repeated 5-word windows.  ``kept``: not that, ``bits`` within the band of
    the language and ``word_bits`` not above that of words.  Null texts count as
    empty and fail; null languages are a language of their own.  Models and
    bands come from all rows of ``docs``; repeated rows count as often as they
    occur.  An empty table gives an empty result.  Columns of ``docs`` with an
    added name come back with ``_input`` behind it.  With ``keep_text`` False the
    text isn't among the columns returned.
    """
    docs = aside(docs, [*BASE, "n_bytes", "bits", "word_bits", "base_failed", "kept", DOC, "_language", "low", "high", "_words_of", "word_high"], (text, language))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    with scratch(docs.sparkSession):  # models and costs
        folder, total_bytes = write_models(count_ngrams(docs, text, language))
        of_words = word_bits(docs, spelling_of(folder), total_bytes, text, language).withColumnRenamed("doc", DOC)
        scored = score(docs, folder, text, language, keep_text).join(of_words, DOC, "left").withColumn("base_failed", failed)
        scored = written(scored.drop(DOC), "scored", stays=True)  # each text is scored once
    slack = F.lit(SHORT) / F.greatest(F.col("n_bytes"), F.lit(1))
    within = (F.col("bits") >= F.col("low") - slack) & (F.col("bits") <= F.col("high") + slack)
    in_order = F.col("word_bits") <= F.col("word_high") + F.lit(SHORT) / F.greatest(F.col("n_words"), F.lit(1))
    joined = scored.join(bands(scored, language), F.col(language).cast("string").eqNullSafe(F.col("_language")), "left")
    of_words = bands(scored, language, "word_bits").select(F.col("_language").alias("_words_of"), F.col("high").alias("word_high"))
    joined = joined.join(of_words, F.col(language).cast("string").eqNullSafe(F.col("_words_of")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within & in_order, F.lit(False))).drop("_language", "low", "high", "_words_of", "word_high")
