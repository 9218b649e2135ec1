"""Vectorised scanning of Arrow string columns inside tasks.

All helpers work on the UTF-8 bytes of a batch.  A null text counts as empty.
Words are maximal runs of bytes other than space and TAB..CR (0x09-0x0D).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A fixed pseudo-random 64-bit value for each byte.
BYTE_VALUE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, kept per worker and grown on demand."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


#: Bytes up to which the polynomial hash tells strings apart; from about 1,000
#: on, strings can be made that it confuses.
SHORT = 256


class SubstringHash:
    """Hashes of any substrings of ``data`` in O(1) each, equal for equal bytes
    wherever they start."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._data = data
        up, self._down = _power_table(n + 1)
        self._sums = np.empty(n + 1, dtype=np.uint64)
        self._sums[0] = 0
        values = BYTE_VALUE[data]
        values *= up[:n]
        np.cumsum(values, out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """As a call, for strings of any length: long ones are digested."""
        out = self(starts, ends)
        for i in np.flatnonzero(ends - starts > SHORT).tolist():
            out[i] = int.from_bytes(blake2b(self._data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets from 0; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: What a worker drops at the end of a task: (a dictionary, the bytes up to which
#: its arrays may stay, or None to clear it, its name).
_caches: list[tuple[dict, int | None, str]] = [(_powers, 64 << 20, "powers")]
#: The name of the cache that tasks of the quality rules leave to one another.
SCORING = "scoring tables"


def task_cache(most: int | None = None, kind: type[dict] = dict, name: str = "") -> dict:
    """A dictionary for what a task's batches share."""
    _caches.append((kind(), most, name))
    return _caches[-1][0]


def give_back(keep: str | None = None) -> None:
    """Drop what tasks have kept and return freed memory to the system: workers
    outlive their tasks, and what one stage holds counts against the executor in
    the next.  ``keep``: the name of a cache that the stage's next task needs again."""
    for cache, most, name in _caches:
        if name == keep:
            continue
        if most is None or sum(x.nbytes for x in cache.values()) > most:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches, text: str, most: int = 1 << 20, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each, so that
    working arrays stay small; one longer text is a slice of its own.  ``keep``:
    see :func:`give_back`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    batch = None
    give_back(keep)


def blank(data: np.ndarray) -> np.ndarray:
    """True at each blank: ``SPACE[data]`` by comparisons, which are cheaper
    than a look-up for each byte."""
    return (data == 0x20) | (data - np.uint8(0x09) < np.uint8(5))


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, never across an offset."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(flag) + 1, dtype=bool)
    edge[0], edge[-1] = flag[0], flag[-1]
    np.not_equal(flag[1:], flag[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    begins, ends = np.ascontiguousarray(at[::2]), np.ascontiguousarray(at[1::2])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flag))]
    inside = np.unique(inner[flag[inner] & flag[inner - 1]])  # offsets within a run end it and begin the next
    if len(inside):
        begins = np.insert(begins, np.searchsorted(begins, inside), inside)
        ends = np.insert(ends, np.searchsorted(ends, inside), inside)
    return begins, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words' bounds, and for each text the index of
    its first word, with the total at the end."""
    starts, ends = runs(~blank(data), offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def tally(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged, for flags that are few."""
    return np.diff(np.searchsorted(np.flatnonzero(flag), offsets))


def met_again(keys: np.ndarray) -> np.ndarray:
    """True for keys that come twice or more.  Sorting values is much cheaper
    than sorting places, and few keys come again."""
    ranked = np.sort(keys)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(again):
        return np.zeros(len(keys), dtype=bool)
    again = again[np.concatenate([[True], again[1:] != again[:-1]])]
    return again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys


def in_group(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each of the consecutive groups of these sizes."""
    total = int(counts.sum())
    begins = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begins, counts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of ``values[first[i]:first[i + 1]]`` for each i."""
    added = np.cumsum(values)
    total = np.zeros(len(added) + 1, dtype=added.dtype)
    total[1:] = added
    return total[first[1:]] - total[first[:-1]]
