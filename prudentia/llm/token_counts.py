"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie.  Its failure links say, for each node, which node
stands for what is left after popping the longest tokens from the node's
string; how many tokens are popped is stored with the link.  A word is then
read once, byte by byte, and only counts are added up: no piece is ever built.
Words are read side by side; where few are left that are longer, each is read
on by itself, so that a word of any length takes time in proportion to it.

Words are whitespace-separated, ASCII letters lower-cased.  A word-end symbol
closes each, so tokens that end words and tokens that don't stay apart.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prudentia.llm.storage import aside
from prudentia.llm.textscan import LOWER, chunks, column_bytes, sums, words

END = 256
SYMBOLS = 257
#: Words below which a step over all of them costs more than one after another.
FEW = 128


def byte_of_letter() -> dict[str, int]:
    """The byte for which each letter of byte-level vocabularies stands.

    Printable Latin-1 bytes stand for themselves, the others for the letters
    from U+0100 on, in order.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str, suffix: str = "</w>") -> list[tuple[int, ...]]:
    """Tokens as symbol tuples, from a tokenizer file; those that are not
    spelt in its letters (special ones) are left out."""
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    letters = byte_of_letter()
    out = []
    for name in names:
        body, last = (name[: -len(suffix)], (END,)) if name.endswith(suffix) else (name, ())
        if (body or last) and all(c in letters for c in body) and not name.startswith("<|"):
            out.append((*(letters[c] for c in body), *last))
    return out


class Automaton:
    """``count(words)`` gives greedy longest-match token counts, -1 for a word
    that the vocabulary cannot spell that way."""

    def __init__(self, tokens: Iterable[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        final: set[int] = set()
        for token in tokens:
            node = 0
            for symbol in token:
                if symbol not in children[node]:
                    children[node][symbol] = len(children)
                    children.append({})
                node = children[node][symbol]
            if token:
                final.add(node)
        n = len(children)
        fail, pops = [-1] * n, [0] * n
        queue = [(0, c, v) for c, v in children[0].items()]
        for parent, symbol, node in queue:
            if node in final:
                fail[node], pops[node] = 0, 1
            else:
                at, popped = fail[parent], pops[parent]
                while at >= 0 and symbol not in children[at]:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], pops[node] = children[at][symbol], popped
            queue.extend((node, c, v) for c, v in children[node].items())
        self._fail, self._pops = np.array(fail), np.array(pops)
        keys = np.array(sorted(v * SYMBOLS + c for v in range(n) for c in children[v]), dtype=np.int64)
        self._alone = {v * SYMBOLS + c: to for v in range(n) for c, to in children[v].items()}, fail, pops
        self._keys = np.append(keys, np.iinfo(np.int64).max)
        self._next = np.array([children[k // SYMBOLS][k % SYMBOLS] for k in keys.tolist()] + [-1])

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = node * SYMBOLS + symbol
        place = np.searchsorted(self._keys, key)
        return np.where(self._keys[place] == key, self._next[place], -1)

    def _read_on(self, node: int, rest: bytes) -> tuple[int, int]:
        """(node, tokens popped) after ``rest`` and the word's end, read from
        ``node``; the node is -1 where no token fits."""
        go, fail, pops = self._alone
        popped = 0
        for symbol in itertools.chain(rest, (END,)):
            while (to := go.get(node * SYMBOLS + symbol)) is None:
                if fail[node] < 0:
                    return -1, popped
                popped += pops[node]
                node = fail[node]
            node = to
        return node, popped

    def count(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Counts for the words ``data[bounds[i]:bounds[i + 1]]``, all read in
        step, longest first so that the ones still being read are a prefix; the
        last few are read on one by one."""
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        sizes, begins = sizes[order], bounds[:-1][order]
        node = np.zeros(len(order), dtype=np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        dead = np.zeros(len(order), dtype=bool)
        read = np.append(data, np.uint8(0))
        for i in range(int(sizes[0]) + 1 if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -i, "right"))
            if live < FEW:
                for k in np.flatnonzero(~dead[:live]).tolist():
                    at, popped = self._read_on(int(node[k]), read[begins[k] + i : begins[k] + sizes[k]].tobytes())
                    node[k], dead[k] = max(at, 0), at < 0
                    total[k] += popped
                break
            symbol = np.where(sizes[:live] > i, read[np.minimum(begins[:live] + i, len(read) - 1)].astype(np.int64), END)
            todo = np.flatnonzero(~dead[:live])
            while len(todo):
                to = self._step(node[todo], symbol[todo])
                went = to >= 0
                node[todo[went]] = to[went]
                todo = todo[~went]
                back = self._fail[node[todo]]
                dead[todo[back < 0]] = True
                todo = todo[back >= 0]
                total[todo] += self._pops[node[todo]]
                node[todo] = self._fail[node[todo]]
        todo = np.flatnonzero(~dead & (node != 0))
        while len(todo):
            back = self._fail[node[todo]]
            dead[todo[back < 0]] = True
            todo = todo[back >= 0]
            total[todo] += self._pops[node[todo]]
            node[todo] = self._fail[node[todo]]
            todo = todo[node[todo] != 0]
        total[dead] = -1
        out = np.empty_like(total)
        out[order] = total
        return out


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton(load_vocabulary(path))
    return _automata[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``n_words``, ``n_tokens``, ``longest_word_tokens`` and ``n_unknown``
    (words without a spelling; they count as one token), all long.

    A null or empty text has 0 of each.  Other columns and repeated rows pass
    unchanged; columns of these names come back with ``_input`` behind them.
    Without ``keep_text`` the text isn't returned.  An empty table gives an
    empty result.
    """
    names = ["n_words", "n_tokens", "longest_word_tokens", "n_unknown"]
    docs = aside(docs, names, (text,))
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in kept], *[T.StructField(n, T.LongType()) for n in names]])

    def count(batches) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary)
        for part in chunks(batches, text):
            data, offsets = column_bytes(part.column(text))
            starts, ends, first = words(data, offsets)
            sizes = ends - starts
            keep = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            body = LOWER[data[keep]]
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            spelt = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
            coded = spelt.dictionary_encode()
            distinct = coded.dictionary
            edges = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
            letters = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else np.zeros(0, np.uint8)
            own = machine.count(letters, edges)[coded.indices.to_numpy(zero_copy_only=False)] if len(sizes) else np.zeros(0, np.int64)
            unknown = own < 0
            own = np.where(unknown, 1, own)
            longest = np.zeros(part.num_rows, dtype=np.int64)
            filled = first[:-1] < first[1:]
            if filled.any():
                longest[filled] = np.maximum.reduceat(own, first[:-1][filled])
            made = [np.diff(first), sums(own, first), longest, sums(unknown, first)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(m, pa.int64()) for m in made]], [*kept, *names])

    return docs.mapInArrow(count, schema)
