"""Encoding whole texts through their distinct segments.

A vocabulary whose pieces never reach over a space into the word before it
encodes a text exactly as the concatenation of its segments, cut before every
single space between two other characters.  Segments repeat, so each distinct
one is encoded once per worker and texts are put together from the results.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from prudentia.llm.textscan import SPACE, column_bytes, in_group

#: Distinct segments that a worker remembers before it starts afresh.
MOST_KEPT = 800_000
#: Segments that are encoded as one text.
JOINED = 256


def cuts(data: np.ndarray) -> np.ndarray:
    """True at each single space between two characters that aren't blank.

    Control characters count as blank, and so does every character that starts
    with a byte which also starts some Unicode blank.
    """
    cut = np.zeros(len(data), dtype=bool)
    if len(data) < 3:
        return cut
    plain = ~SPACE & (np.arange(256) > 0x20)
    leads = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
    wary = leads[data]
    cut[1:-1] = (data[1:-1] == 0x20) & plain[data[:-2]] & plain[data[2:]] & ~wary[2:]
    high = data >= 0x80
    cut[2:] &= ~(high[1:-1] & wary[:-2])
    cut[3:] &= ~(high[2:-1] & wary[:-3])
    return cut


def listed(lists: list, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and how many each has."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=dtype, count=int(sizes.sum())), sizes


def joined(encode: Callable[[list[str]], list], id_bytes: np.ndarray, dtype=np.int32) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """``encode`` for segments, called with up to ``JOINED`` of them as one text.

    They are joined only where the text would be cut again, and told apart by the
    bytes that each id stands for (``id_bytes``).  If these don't meet the bounds of
    the segments, the encoder isn't one over bytes, and each is encoded by itself.
    """

    def run(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in parts]
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        whole = b"".join(raw)
        begins = np.concatenate([[0], ends[:-1]])
        apart = ~cuts(np.frombuffer(whole, np.uint8))[begins]
        apart[::JOINED] = True
        at = [*begins[apart].tolist(), len(whole)]
        lists = encode([whole[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)])
        flat, _ = listed(lists, dtype)
        until = np.cumsum(id_bytes[flat])
        last = np.searchsorted(until, ends)
        if len(until) and until[-1] == len(whole) and (until[last] == ends).all():
            return flat, np.diff(last + 1, prepend=0)
        return listed(encode(parts), dtype)

    return run


class SegmentEncoder:
    """``encode(list of str) -> list of id lists``, or the ids of all and how many
    each has, applied to distinct segments.

    With ``cut`` False whole texts are the segments.  With ``drop`` the space
    that a segment was cut at is left out, for encoders that put one before
    every text by themselves.
    """

    def __init__(self, encode: Callable[[list[str]], list], dtype=np.int32, cut: bool = True, drop: bool = False, most: int = MOST_KEPT):
        self._encode, self._dtype, self._cut, self._drop, self._most = encode, dtype, cut, drop, most
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, dtype=self._dtype)
        self._begin = np.zeros(1 << 14, dtype=np.int64)
        self._length = np.zeros(1 << 14, dtype=np.int64)
        self._used = 0

    def _learn(self, fresh: list[str]) -> None:
        made = self._encode(fresh)
        flat, sizes = made if isinstance(made, tuple) else listed(made, self._dtype)
        n = len(self._known)
        while len(self._begin) < n + len(fresh):
            self._begin = np.concatenate([self._begin, np.zeros_like(self._begin)])
            self._length = np.concatenate([self._length, np.zeros_like(self._length)])
        while len(self._ids) < self._used + len(flat):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(flat)] = flat
        self._begin[n : n + len(fresh)] = self._used + np.cumsum(sizes) - sizes
        self._length[n : n + len(fresh)] = sizes
        self._used += len(flat)
        self._known.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def segments(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(segments, first, starts): all segments, for each text the index of
        its first one with the total at the end, and where in the column's
        bytes each begins.  An empty text has none."""
        data, offsets = column_bytes(column)
        n = len(data)
        cut = cuts(data) if self._cut else np.zeros(n, dtype=bool)
        filled = offsets[:-1] < offsets[1:]
        begins = offsets[:-1][filled]
        cut[offsets[1:][filled] - 1] = False  # a space that ends its text
        cut[begins] = False
        inner = np.flatnonzero(cut)
        cut[begins] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, n).astype(np.int64)
        if self._drop and len(inner):
            keep = np.ones(n, dtype=bool)
            keep[inner] = False
            bounds -= np.searchsorted(inner, bounds)
            data = data[keep]
        made = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        return made, np.searchsorted(starts, offsets), starts

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all texts, and for each text where its own
        begin, with the total at the end."""
        parts, first, _ = self.segments(column)
        ids, counts = self.encode(parts)
        return ids, np.concatenate([[0], np.cumsum(counts)])[first]

    def encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all segments, and how many each has."""
        if not len(parts):
            return np.zeros(0, self._dtype), np.zeros(0, np.int64)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        place = np.fromiter(map(self._known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        fresh = np.flatnonzero(place < 0)
        if len(self._known) + len(fresh) > self._most:
            self._forget()
            fresh = np.arange(len(distinct))
        if len(fresh):
            n = len(self._known)
            self._learn([distinct[i] for i in fresh.tolist()])
            place[fresh] = np.arange(n, n + len(fresh))
        place = place[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self._length[place]
        return self._ids[np.repeat(self._begin[place], counts) + in_group(counts)], counts
