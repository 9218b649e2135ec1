"""A word model over all documents: interpolated modified Kneser-Ney, order 3.

What it gathers grows with the corpus: all word trigrams are counted with sums
in each task and an exchange, and kept as sorted hash arrays in partitions.
Everything that the orders 3 and 2 need of a trigram hangs on its middle word,
so trigrams are dealt by that: a bucket of middle words knows its counts,
contexts and continuations by itself, and the documents' own entries, packed
beside the counts, are scored where they are.  Below order 2 stands the spelling
of the word under the byte model, which knows words never seen.

A middle word met more than ``HEAVY`` times is told apart by the hash of the
word before it, into as many parts as keep each below that number.  Its trigrams
and contexts are then whole in a part; its continuations are summed over the parts,
and each part is told the sums of its own pairs and of the word before it is scored.

The work goes in ``ROUNDS``, each with the middle words of one residue of their
hashes, all documents and discounts of its own; what a round has exchanged is
dropped before the next begins.

A document is scored as if it weren't in the corpus: its own counts leave those
of its n-grams and contexts.  Otherwise words in an order of their own, whose
n-grams nobody else has, would predict themselves.  Below order 3 an n-gram
that only the document has leaves the kinds it was counted for by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prudentia.llm.storage import discard, new_dir, release, written
from prudentia.llm.textscan import SCORING, SubstringHash, chunks, column_bytes, give_back, met_again, mix, words

U64 = np.uint64
SPREAD = U64(0xD1342543DE82EF95)
ROUNDS = 5
#: Occurrences above which a middle word is told apart by the word before.
HEAVY = 1_000_000
#: Bytes of text that a bucket of a round stands for, at about.
BUCKET_BYTES = 3 << 20
#: Bits of a middle word's hash in a bucket.
MIDDLE_BITS = 40
#: Words of the documents that are packed together.
PACK_WORDS = 4_000_000
#: Steps of a bit in which spellings are kept, and the most bits of a word.
SPELL_STEPS, MOST_BITS = 4, 40.0
#: The packed columns of an entry: middle word, word, word before, document,
#: which of the packs it came with, occurrences in the document, spelling.
ENTRY = {"g": np.uint64, "b": np.uint32, "a": np.uint32, "doc": np.uint32, "pack": np.uint32, "n": np.uint32, "spell": np.uint8}
#: Those packed as planes of bytes, as all but their low bytes are much alike.
PLANES = ("g", "doc", "pack", "n")
#: Bits of a document's number among those packed together, at most that many.
DOC_BITS = 20


def _digest(raw: bytes) -> int:
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little")


def doc_keys(data: np.ndarray, offsets: np.ndarray, languages: list) -> np.ndarray:
    """A 64-bit digest of each document's language and text."""
    salt = [b"-" if x is None else b"+" + x.encode() + b"\0" for x in languages]
    raw = data.tobytes()
    return np.array([_digest(s + raw[a:b]) for s, a, b in zip(salt, offsets[:-1], offsets[1:], strict=True)], dtype=U64).view(np.int64)


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Entries sorted by ``g``, compressed; ``g`` as differences."""
    parts = []
    for name, kind in ENTRY.items():
        values = np.ascontiguousarray(columns[name].astype(kind, copy=False))
        if name == "g":
            values = np.diff(values, prepend=U64(0))
        if name in PLANES:
            values = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
        parts.append(values.tobytes())
    return pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> dict[str, np.ndarray]:
    raw = np.frombuffer(pa.decompress(packed, n * sum(np.dtype(k).itemsize for k in ENTRY.values()), codec="zstd", asbytes=True), np.uint8)
    out, at = {}, 0
    for name, kind in ENTRY.items():
        width = np.dtype(kind).itemsize
        part = raw[at : at + n * width]
        out[name] = np.ascontiguousarray(part.reshape(width, n).T).view(kind).ravel() if name in PLANES else np.frombuffer(part.tobytes(), kind)
        at += n * width
    out["g"] = np.cumsum(out["g"])
    return out


# ---- middle words that are met very often ---------------------------------


def _word_hashes(data: np.ndarray, offsets: np.ndarray, languages: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(hash of each word with its language, hash of the language, its text, bounds)."""
    known = {x: _digest(b"-" if x is None else b"+" + x.encode()) for x in set(languages)}
    bounds = starts, ends, first = words(data, offsets)
    owner = np.repeat(np.arange(len(languages)), np.diff(first))
    lang = np.array([known[x] for x in languages], dtype=U64)[owner]
    hashes = SubstringHash(data).strings(starts, ends)
    hashes ^= lang
    return hashes, lang, owner, bounds


def heavy_words(docs: DataFrame, text: str, language: str, total_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, parts): words met over ``HEAVY`` times, sorted, at most one for
    every ``HEAVY`` bytes of text; they come to the driver.

    Tasks name words that are frequent among their own; a word named nowhere is
    met less than half of ``HEAVY`` times.  What is listed, and into how many parts,
    decides how the work is dealt and nothing else.
    """

    def count(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, keep=SCORING):
            w, _, _, _ = _word_hashes(*column_bytes(part.column(text)), part.column(language).to_pylist())
            keys, n = np.unique(w, return_counts=True)
            often = n >= len(w) * (HEAVY / max(1, total_bytes))
            yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["w", "n"])

    narrow = docs.select(F.col(language).cast("string").alias(language), F.col(text).alias(text))
    found = narrow.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY // 2).collect()
    hashes = np.array([r.w for r in found], dtype=np.int64).view(U64)
    parts = np.array([2 * r.n // HEAVY + 1 for r in found], dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], parts[order]


def part_codes(heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(``g`` of each part of the heavy words, sorted; the word's place in the list)."""
    hashes, parts = heavy
    word = np.repeat(np.arange(len(hashes)), parts)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    codes = mix(hashes[word] + U64(1) + nth.astype(U64)) >> U64(64 - MIDDLE_BITS)
    order = np.argsort(codes)
    return codes[order], word[order]


# ---- the entries of a round -------------------------------------------------


def _entries(part: pa.RecordBatch, text: str, language: str, spelling: Callable, heavy: tuple[np.ndarray, np.ndarray], turn: int) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
    """(entries of the round, doc keys, words): one entry for each different
    trigram of a document; two marks stand before a text."""
    data, offsets = column_bytes(part.column(text))
    languages = part.column(language).to_pylist()
    w, lang, owner, (starts, ends, first) = _word_hashes(data, offsets, languages)
    mid = np.empty_like(w)
    mid[1:] = w[:-1]
    opening = first[:-1][first[:-1] < first[1:]]  # the first word of each text
    mid[opening] = mix(lang[opening] + U64(1))
    own = np.flatnonzero(mid % U64(ROUNDS) == U64(turn))
    begin = first[:-1][owner[own]]
    mark = mix(lang[own] + U64(1))
    far = np.where(own - begin > 1, w[np.maximum(own - 2, 0)], mark)
    mid = mid[own]
    hashes, parts = heavy
    if len(hashes) and len(own):
        at = np.minimum(np.searchsorted(hashes, mid), len(hashes) - 1)
        mid = np.where(hashes[at] == mid, mid + U64(1) + far % parts[at].astype(U64), mid)
    g, b, a, doc = mix(mid) >> U64(64 - MIDDLE_BITS), w[own] >> U64(32), far >> U64(32), owner[own]
    key = mix((g * SPREAD + b) * SPREAD + a + doc.astype(U64))
    again = met_again(key)
    several = np.flatnonzero(again)
    several = several[np.argsort(key[several])]
    new = np.flatnonzero(_runs(key[several]))
    at = np.concatenate([np.flatnonzero(~again), several[new]])
    n = np.concatenate([np.ones(len(key) - len(several), dtype=np.int64), np.diff(np.append(new, len(several)))])
    starts, doc = starts[own][at], doc[at]
    bits = spelling(data, offsets, languages, starts, np.minimum(ends[own][at] + 1, offsets[1:][doc]), doc)  # the byte after a word ends its spelling
    spelled = np.clip(np.round(SPELL_STEPS * bits), 1, 255)
    kinds = {x: k for k, x in enumerate(dict.fromkeys(languages))}
    of = np.array([kinds[x] for x in languages], dtype=np.int64)[doc]
    columns = {"g": g[at], "b": b[at], "a": a[at], "doc": doc, "pack": np.zeros(len(at)), "n": n, "spell": spelled}
    return {c: v.astype(ENTRY[c]) for c, v in columns.items()} | {"of": of}, doc_keys(data, offsets, languages), len(w)


_PACKED = "lang string, bucket long, chunk long, n long, body binary"


def _packed(docs: DataFrame, text: str, language: str, spelling: Callable, heavy, turn: int, buckets: int) -> DataFrame:
    """(lang, bucket, chunk, n, body): the entries of some documents, packed for
    each bucket; under buckets below 0 the keys of those documents."""
    shift = U64(MIDDLE_BITS - buckets.bit_length() + 1)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, dict[str, np.ndarray]]] = []
        keys: list[np.ndarray] = []
        docs_held = words_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            all_keys = np.concatenate(keys)
            chunk = int(np.array([_digest(all_keys.tobytes())], dtype=U64).view(np.int64)[0])
            rows: list[tuple] = [(None, -1 - (chunk & 0xFFFF), chunk, len(all_keys), all_keys.tobytes())]
            for lang in dict.fromkeys(x for x, _ in held):
                entries = {c: np.concatenate([e[c] for x, e in held if x == lang]) for c in ENTRY}
                order = np.argsort(entries["g"])
                entries = {c: v[order] for c, v in entries.items()}
                if not len(order):
                    continue
                bucket = entries["g"] >> shift
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(order)]
                rows += [(lang, int(bucket[i]), chunk, j - i, pack({c: v[i:j] for c, v in entries.items()})) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["lang", "bucket", "chunk", "n", "body"])

        for part in chunks(batches, text, keep=SCORING):
            entries, own_keys, n_words = _entries(part, text, language, spelling, heavy, turn)
            languages = part.column(language).to_pylist()
            entries["doc"] += np.uint32(docs_held)
            for k, lang in enumerate(dict.fromkeys(languages)):
                mine = entries["of"] == k
                held.append((lang, {c: entries[c][mine] for c in ENTRY}))
            keys.append(own_keys)
            docs_held, words_held = docs_held + len(own_keys), words_held + n_words
            if words_held >= PACK_WORDS or docs_held >= 1 << DOC_BITS - 1:
                yield from out()
                held, keys, docs_held, words_held = [], [], 0, 0
        if keys:
            yield from out()

    narrow = docs.select(F.col(language).cast("string").alias(language), F.col(text).alias(text))
    return narrow.mapInArrow(run, _PACKED)


# ---- the model of a bucket --------------------------------------------------


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    new = np.ones(len(sorted_columns[0]), dtype=bool)
    new[1:] = sorted_columns[0][1:] != sorted_columns[0][:-1]
    for c in sorted_columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return new


class Bucket:
    """Entries with the counts of their trigrams, contexts and continuations,
    those of a middle word together, then of a word, then of a word before.  It
    takes the dictionary it is given over and orders its columns in place."""

    def __init__(self, entries: dict[str, np.ndarray], ordered: bool = False):
        if not ordered:
            order = np.argsort(entries["g"])
            middle = np.cumsum(_runs(entries["g"][order])).astype(U64) << U64(32)
            inner = np.argsort(middle | entries["b"][order])
            order, middle = order[inner], middle[inner]
            pair = np.cumsum(_runs(middle, entries["b"][order])).astype(U64) << U64(32)
            del middle, inner
            order = order[np.argsort(pair | entries["a"][order])]
            del pair
            for c in entries:  # one column at a time: a bucket may be large
                entries[c] = entries[c][order]
            del order
        self.entries = entries
        g, b, a = (self.entries[c] for c in ("g", "b", "a"))
        self.n = self.entries["n"].astype(np.int64)
        new = _runs(g, b, a)
        self.gram = np.cumsum(new, dtype=np.int32) - 1  # of each entry
        first = np.flatnonzero(new)
        self.count = np.add.reduceat(self.n, first) if len(first) else np.zeros(0, np.int64)
        pairs = _runs(g[first], b[first])
        self.pair_g, self.pair_b = g[first][pairs], b[first][pairs]
        self.pair = np.cumsum(pairs, dtype=np.int32) - 1  # of each trigram
        self.kinds = np.bincount(self.pair, minlength=int(pairs.sum()))  # words before each pair
        middle = np.cumsum(_runs(g[first]), dtype=np.int32) - 1
        self.middle = middle[pairs]  # of each pair
        self._contexts = (middle, a[first])

    @cached_property
    def context(self) -> np.ndarray:
        """The context of each trigram: only scoring asks for it."""
        middle, before = self._contexts
        return np.unique((middle.astype(U64) << U64(32)) | before, return_inverse=True)[1].astype(np.int32)

    def shared(self, codes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of heavy words, the word of each): other parts may have them too."""
        if not len(codes[0]) or not len(self.pair_g):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(codes[0], self.pair_g), len(codes[0]) - 1)
        mine = np.flatnonzero(codes[0][at] == self.pair_g)
        return mine, codes[1][at[mine]]

    def counts_of_counts(self, shared: np.ndarray) -> list[int]:
        """How many trigrams, then pairs but for the ``shared``, have counts 1 to 4."""
        return [int(np.count_nonzero(c == k)) for c in (self.count, np.delete(self.kinds, shared)) for k in (1, 2, 3, 4)]

    @staticmethod
    def _sums(n, of, cut):
        """(counts, discounts) of all n-grams with the context of each."""
        return np.bincount(of, n)[of], np.bincount(of, cut[np.minimum(n, 3)])[of]

    @staticmethod
    def _level(n, total, held, cut, own, own_of_context, at, below):
        """p of one order without the document's own counts.  n: counts of the
        n-grams, total, held: see :meth:`_sums`, at: the n-gram of each entry."""
        total = total[at] - own_of_context
        rest = n[at] - own
        after = cut[np.clip(rest, 0, 3)]
        mass = held[at] - cut[np.minimum(n[at], 3)] + after
        some = np.maximum(total, 1)
        p = (rest - after) / some + np.minimum(mass / some, 1.0) * below
        return np.where(total > 0, np.minimum(p, 1.0), below)

    def bits(self, cut_3: np.ndarray, cut_2: np.ndarray, shared: tuple | None = None) -> np.ndarray:
        """Bits of one occurrence of each entry; cut: the discounts of counts 0
        to 3 and more, for trigrams and for pairs; shared: pairs of heavy words,
        their kinds over all parts, and of each one's word what :func:`_of_words`
        has."""
        if not len(self.n):
            return np.zeros(0)
        doc = self.entries["doc"].astype(U64) | (self.entries["pack"].astype(U64) << U64(DOC_BITS))
        key = mix(self.context[self.gram].astype(U64) * SPREAD + doc)
        several = np.flatnonzero(met_again(key))  # contexts that come again in their document
        _, back = np.unique(key[several], return_inverse=True)
        own_context = self.n.copy()
        own_context[several] = np.bincount(back, self.n[several])[back] if len(several) else 0
        alone = (self.count[self.gram] == self.n).astype(np.int64)  # no other document has it
        p = 2.0 ** -(self.entries["spell"].astype(np.float64) / SPELL_STEPS)
        kinds, (total, held) = self.kinds, self._sums(self.kinds, self.middle, cut_2)
        if shared is not None:
            at, of_pairs, of_words = shared
            kinds = kinds.copy()
            kinds[at], total[at] = of_pairs, of_words[:, 0]
            held[at] = of_words[:, 2:4] @ cut_2[1:3] + (of_words[:, 1] - of_words[:, 2:4].sum(axis=1)) * cut_2[3]
        p = self._level(kinds, total, held, cut_2, alone, alone, self.pair[self.gram], p)
        p = self._level(self.count, *self._sums(self.count, self.context, cut_3), cut_3, self.n, own_context, self.gram, p)
        return np.minimum(-np.log2(np.maximum(p, 1e-30)), MOST_BITS)


def _by(batches, names: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of each key, for input sorted by it."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[c] for c in names)
            if held and key != last:
                yield held
                held = []
            held.append(row)
            last = key
    if held:
        yield held


_MODEL_ARROW = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("body", pa.binary()), ("chunks", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64())), ("shared", pa.binary())])
_MODEL = "lang string, bucket long, chunk long, n long, body binary, chunks array<long>, kinds array<long>, shared binary"
#: A pair of a heavy word: the word's place in the list, the word after, kinds.
_SHARE = np.dtype([("b", np.uint32), ("word", np.uint32), ("kinds", np.int64)])


def _models(packed: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row for each bucket: its sorted entries, whose documents are numbered
    by ``chunks``, its counts of counts and its ``shared`` pairs of heavy words, if
    it has any.  Rows of doc keys pass."""
    codes = part_codes(heavy)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, ("lang", "bucket")):
            if rows[0]["bucket"] < 0:
                made = [r | {"chunks": [], "kinds": [], "shared": None} for r in rows]
            else:
                pieces = []
                for k, row in enumerate(rows):
                    piece = unpack(row["body"], row["n"])
                    piece["pack"] = np.full(len(piece["g"]), k, dtype=np.uint32)
                    pieces.append(piece)
                bucket = Bucket({c: np.concatenate([p.pop(c) for p in pieces]) for c in ENTRY})
                at, word = bucket.shared(codes)
                pairs, back = np.unique(word.astype(U64) << U64(32) | bucket.pair_b[at], return_inverse=True)
                shares = np.empty(len(pairs), dtype=_SHARE)
                shares["b"], shares["word"] = pairs & U64(0xFFFFFFFF), pairs >> U64(32)
                shares["kinds"] = np.bincount(back, bucket.kinds[at], len(pairs))  # several parts of a word may lie here
                made = [{"lang": rows[0]["lang"], "bucket": rows[0]["bucket"], "chunk": 0, "n": len(bucket.n), "body": pack(bucket.entries), "chunks": [r["chunk"] for r in rows], "kinds": bucket.counts_of_counts(at), "shared": shares.tobytes() if len(at) else None}]
            yield pa.RecordBatch.from_pylist(made, _MODEL_ARROW)
            bucket = made = None
        give_back(SCORING)

    return packed.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(run, _MODEL)


_SHARES = "lang string, bucket long, word long, b long, total long, first boolean"


def _shares(models: DataFrame) -> DataFrame:
    """(lang, bucket, word, b, total, first): the pairs of heavy words in each bucket
    with their kinds over all buckets; ``first`` is true once for a pair."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, bucket, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = np.frombuffer(body, _SHARE)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(rows)), pa.repeat(pa.scalar(bucket, pa.int64()), len(rows)), *(pa.array(rows[c].astype(np.int64)) for c in ("word", "b", "kinds"))], ["lang", "bucket", "word", "b", "kinds"])

    each = models.where("shared IS NOT NULL").select("lang", "bucket", "shared").mapInArrow(run, "lang string, bucket long, word long, b long, kinds long")
    alike = W.partitionBy("lang", "word", "b")  # a row for each part of the word at most
    return each.select("lang", "bucket", "word", "b", F.sum("kinds").over(alike).alias("total"), (F.col("bucket") == F.min("bucket").over(alike)).alias("first"))


def _of_words(shares: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> dict[str | None, np.ndarray]:
    """By language, for each heavy word: the sum of its pairs' kinds, its pairs, and
    those of 1 to 4 kinds.  A row for each heavy word comes to the driver."""
    some = [F.sum((F.col("total") == k).cast("long")) for k in (1, 2, 3, 4)]
    rows = shares.where("first").groupBy("lang", "word").agg(F.sum("total"), F.count("*"), *some).collect()
    out: dict[str | None, np.ndarray] = {}
    for lang, word, *numbers in rows:
        out.setdefault(lang, np.zeros((len(heavy[0]), 6), dtype=np.int64))[word] = numbers
    return out


def _told(shares: DataFrame) -> DataFrame:
    """(_lang, _bucket, told): what each bucket is told of its pairs, sorted by word
    and word after."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.string()), pa.array([last[1]], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["_lang", "_bucket", "told"])

        for batch in batches:
            rows = np.empty(batch.num_rows, dtype=_SHARE)
            for c, name in (("word", "word"), ("b", "b"), ("kinds", "total")):
                rows[c] = batch.column(name).to_numpy()
            bucket, lang = batch.column("bucket").to_numpy(), np.array(batch.column("lang").to_pylist(), dtype=object)
            cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1])) + 1).tolist(), len(rows)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    if held and (lang[i], int(bucket[i])) != last:
                        yield out()
                        held = []
                    last = lang[i], int(bucket[i])
                    held.append(rows[i:j].tobytes())
        if held:
            yield out()

    return shares.select("lang", "bucket", "word", "b", "total").repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "word", "b").mapInArrow(run, "_lang string, _bucket long, told binary")


# ---- bits -------------------------------------------------------------------


def _cuts(kinds: list[int]) -> np.ndarray:
    """Discounts of the counts 0, 1, 2 and 3 or more, from how many n-grams have
    counts 1 to 4; 0.5, 1 and 1.5 where those tell nothing."""
    n1, n2, n3, n4 = map(float, kinds)
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))])


_SUMS = "chunk long, n long, body binary"
_SUM = np.dtype([("doc", np.uint32), ("words", np.uint32), ("cost", np.int64)])


def _costs(models: DataFrame, shares: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(chunk, n, body): for documents packed together, sums over some buckets
    of the bits of each one's entries, in millionths (whole numbers, whose order
    doesn't count), and of its words."""
    codes, of_words, buckets = part_codes(heavy), _of_words(shares, heavy), models.where("bucket >= 0")
    of_parts = [(lang, [0, 0, 0, 0, *map(int, n[:, 2:].sum(axis=0))]) for lang, n in of_words.items()]
    own = buckets.select("lang", "kinds").union(models.sparkSession.createDataFrame(of_parts, "lang string, kinds array<long>"))
    named = own.groupBy("lang").agg(F.array(*[F.sum(F.col("kinds")[k]) for k in range(8)]).alias("all_kinds"))
    named = written(named.select(F.col("lang").alias("_of"), "all_kinds"), "word-kinds")  # a row for each language

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = []
            for chunk, parts in held.items():
                every = np.concatenate(parts)
                _, summed = _summed(every["doc"].astype(np.int64), every["cost"], every["words"])
                rows.append((chunk, len(summed), pa.compress(summed.tobytes(), codec="zstd", asbytes=True)))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["chunk", "n", "body"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                bucket = Bucket(unpack(row["body"], row["n"]), ordered=True)
                shared = None
                if row["told"] is not None:
                    told = np.frombuffer(row["told"], _SHARE)
                    at, word = bucket.shared(codes)
                    place = np.searchsorted(told["word"].astype(U64) << U64(32) | told["b"], word.astype(U64) << U64(32) | bucket.pair_b[at])
                    shared = at, told["kinds"][place], of_words[row["lang"]][word]
                bits = bucket.bits(_cuts(row["all_kinds"][:4]), _cuts(row["all_kinds"][4:]), shared)
                cost = np.round(bits * bucket.n * 1e6).astype(np.int64)
                doc = bucket.entries["doc"].astype(np.int64) | bucket.entries["pack"].astype(np.int64) << DOC_BITS
                n, bucket, bits, shared = bucket.n, None, None, None  # freed before they are summed
                keys, summed = _summed(doc, cost, n)
                cuts = np.flatnonzero(_runs(keys >> DOC_BITS))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=False):
                    held.setdefault(row["chunks"][int(keys[a]) >> DOC_BITS], []).append(summed[a:b])
                size += len(keys)
                if size >= 2_000_000:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()
        give_back(SCORING)

    rows = buckets.where("shared IS NULL").select("lang", "n", "body", "chunks", F.lit(None).cast("binary").alias("told"))
    if of_words:  # only buckets with a part of a heavy word move
        both = buckets.where("shared IS NOT NULL").join(_told(shares), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("bucket") == F.col("_bucket")))
        rows = rows.union(both.select("lang", "n", "body", "chunks", "told"))
    rows = rows.join(named, F.col("lang").eqNullSafe(F.col("_of")))
    return rows.select("lang", "n", "body", "chunks", "all_kinds", "told").mapInArrow(run, _SUMS)


def _summed(doc: np.ndarray, cost: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, sums of each): the lowest ``DOC_BITS`` name it in the sums."""
    order = np.argsort(doc)
    first = np.flatnonzero(_runs(doc[order]))
    keys, out = doc[order][first], np.zeros(len(first), dtype=_SUM)
    if len(first):
        out["doc"], out["cost"], out["words"] = keys & (1 << DOC_BITS) - 1, np.add.reduceat(cost[order], first), np.add.reduceat(n[order], first)
    return keys, out


def _by_document(costs: DataFrame, models: DataFrame) -> DataFrame:
    """(key, cost, n) of each document."""
    keys = models.where("bucket < 0").select("chunk", F.lit(-1).cast("long").alias("n"), "body")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, ("chunk",)):
            own = np.frombuffer(next(r["body"] for r in rows if r["n"] < 0), np.int64)  # equal ones hold the same keys
            cost, words_ = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
            for r in rows:
                if r["n"] > 0:
                    part = np.frombuffer(pa.decompress(r["body"], r["n"] * _SUM.itemsize, codec="zstd", asbytes=True), _SUM)
                    cost[part["doc"]] += part["cost"]
                    words_[part["doc"]] += part["words"]
            at = np.flatnonzero(words_)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (own, cost, words_)], ["key", "cost", "n"])
        give_back(SCORING)

    return costs.union(keys).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "key long, cost long, n long")


def word_bits(docs: DataFrame, spelling: Callable, total_bytes: int, text: str = "text", language: str = "lang") -> DataFrame:
    """(doc, word_bits): mean bits per word of every text with words, under the
    model of all other documents of its language; see :func:`doc_keys`.

    ``spelling(data, offsets, languages, begin, end, doc)`` gives the bits under
    the byte model of stretches of bytes and the text that each is of;
    ``total_bytes`` is about the size of all texts.
    """
    spark = docs.sparkSession
    heavy = heavy_words(docs, text, language, total_bytes)
    wanted = max(1, total_bytes // (ROUNDS * BUCKET_BYTES))
    buckets = 1 << (wanted - 1).bit_length()

    def turn_of(turn: int) -> DataFrame:
        folder = new_dir(spark, "word-model")
        _models(_packed(docs, text, language, spelling, heavy, turn, buckets), heavy).write.parquet(folder)
        release(spark)
        models = spark.read.schema(_MODEL).parquet(folder)
        of_parts = new_dir(spark, "word-shares")
        (_shares(models) if len(heavy[0]) else spark.createDataFrame([], _SHARES)).write.parquet(of_parts)
        costs = written(_by_document(_costs(models, spark.read.schema(_SHARES).parquet(of_parts), heavy), models), "word-costs")
        for path in (folder, of_parts):
            discard(spark, path)
        release(spark)
        return costs

    every = turn_of(0)
    for turn in range(1, ROUNDS):
        every = every.union(turn_of(turn))
    summed = every.groupBy("key").agg((F.sum("cost") / F.sum("n") / 1e6).alias("word_bits"))
    return summed.select(F.col("key").alias("doc"), F.round("word_bits", 6).alias("word_bits"))
