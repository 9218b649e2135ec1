"""Periodic runs of words, found lag by lag with bit planes.

A text's words become numbers, and each binary digit of these numbers one long
integer with a bit for every word.  A plane XOR itself shifted by ``q`` has a bit
wherever the digit differs between words ``q`` apart; the OR over all planes has
one wherever the words differ.  Ones of its complement that stand together long
enough are found by AND with shifted copies, doubling the shift; each such
stretch is a run of period ``q``.

Which lags are worth the planes is told by windows of words: within a run of
smallest period ``q``, a window at least ``q`` and less than ``2 q`` wide comes
again ``q`` words further and not before, as no primitive word lies within its
own square but at its ends.  So windows of 1, 2, 4, ... words, of which only
those that recur are doubled, name every lag that has a run and few others, and
the work grows as the words and not as their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prudentia.llm.storage import aside
from prudentia.llm.textscan import chunks

#: A run repeats its period at least so often and has at least so many words.
TIMES, LEAST = 4, 6
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def likely_lags(ids: np.ndarray) -> list[int]:
    """All lags that have a run, ascending, and some that may have none."""
    n, found = len(ids), set()
    at, key, width = np.arange(n), ids, 1
    while 4 * (width // 2 + 1) <= n:
        order = np.argsort(key, kind="stable")
        ranked, places = key[order], at[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            break
        here, again = places[:-1][same], places[1:][same]
        gap = again - here
        fits = (2 * gap > width) & (gap <= width)
        if fits.any():
            begin, lag = here[fits], gap[fits]
            sorts = np.argsort(begin)
            begin, lag = begin[sorts], lag[sorts]
            edge = np.concatenate([[True], (np.diff(begin) != 1) | (np.diff(lag) != 0)])
            first = np.flatnonzero(edge)
            enough = np.diff(np.append(first, len(lag))) > lag[first]
            found.update(lag[first][enough].tolist())
        recurs = np.zeros(n + width, dtype=bool)
        recurs[here] = recurs[again] = True
        rank = np.zeros(n + width, dtype=np.int64)
        rank[places] = np.cumsum(np.concatenate([[0], ~same]))
        at = np.flatnonzero(recurs[:n] & recurs[width:])
        key = rank[at] * (n + 1) + rank[at + width]
        width *= 2
    return sorted(found)


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit i of plane b is bit b of ``ids[i]``."""
    digits = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b) & 1 == 1, bitorder="little").tobytes(), "little") for b in range(digits)]


def _ones(x: int) -> np.ndarray:
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def runs_of_lag(planes: list[int], n: int, lag: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches in which words ``lag`` apart agree
    and that are long enough."""
    need = max(LEAST, TIMES * lag) - lag
    if n - lag < need:
        return []
    differ = 0
    for plane in planes:
        differ |= plane ^ (plane >> lag)
    starts, have = ~differ & ((1 << (n - lag)) - 1), 1
    while have < need and starts:
        step = min(have, need - have)
        starts &= starts >> step
        have += step
    if not starts:
        return []
    first, last = _ones(starts & ~(starts << 1)), _ones(starts & ~(starts >> 1))
    return [(int(s), int(e - s) + need + lag) for s, e in zip(first, last, strict=True)]


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n, out, planes = len(ids), [], None
    if n < LEAST:
        return out
    for lag in likely_lags(ids):
        planes = planes_of(ids) if planes is None else planes
        for start, length in runs_of_lag(planes, n, lag):
            smaller = any(lag % p == 0 and s <= start and start + length <= s + m for s, m, p in out)
            if not smaller:
                out.append((start, length, lag))
    return sorted(out, key=lambda run: (run[0], run[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text", keep_text: bool = True, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, ident: str = "doc_id") -> DataFrame:
    """Add ``runs``, an array of (start, length, period) in words, and ``collapsed``,
    the text's words without those that runs repeat, joined by one space.

    Words are maximal stretches without space, TAB, LF, VT, FF and CR.  A run is a
    stretch with smallest period q and at least max(6, 4 q) words that can't be
    extended.  ``rewrite`` may change a text's words before (it gets the row's
    ``ident`` and the words).  Null and empty texts have no runs and an empty
    collapsed text.  Rows are independent: ties, repeated rows and null ids are
    nothing special, other columns pass, and columns named ``runs`` or
    ``collapsed`` come back with ``_input`` behind their names.  An empty table
    gives an empty result.  A task holds one text of any length at a time.
    """
    docs = aside(docs, ["runs", "collapsed"], (text, ident))
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    of_run = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            found, left = [], []
            idents = part.column(ident).to_pylist() if rewrite else [None] * part.num_rows
            for one, body in zip(idents, part.column(text), strict=True):
                words = (body.as_py() or "").encode().split()
                if rewrite:
                    words = rewrite(one, words)
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                runs = runs_of(ids)
                found.append([{"start": s, "length": m, "period": p} for s, m, p in runs])
                left.append(b" ".join(collapsed(words, runs)).decode())
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(found, of_run), pa.array(left, pa.string())], [*names, "runs", "collapsed"])

    return docs.mapInArrow(scan, schema)
