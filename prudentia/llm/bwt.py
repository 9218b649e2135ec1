"""Merging Burrows-Wheeler transforms by iterative interleave refinement.

A collection of byte strings is read in symbols of ``WIDTH`` bytes: each string
gives WIDTH sequences, one per phase, so every byte position starts a suffix.
Symbols are ordered by a 64-bit hash; any total order serves, as only equality
of prefixes is asked for.  Each shard of the collection has its own transform:
its suffixes in order, and before each of them a symbol.

The transforms are merged without sorting suffixes again.  The interleave says
for each place of the merged order which shard it comes from.  At first shards
follow one another; each round sends every place to the block of the symbol
before it, keeping the order, and so sorts by one symbol more.  Where a round
tells two neighbours apart for the first time, their common prefix is as long
as the rounds before.  After as many rounds as a wanted length has symbols, the
places not told apart are the repeated intervals of that length.
"""

from __future__ import annotations

import numpy as np

from prudentia.llm.textscan import SubstringHash, in_group

#: Bytes of a symbol.
WIDTH = 25
_LOW = np.int64((1 << 32) - 1)


class Collection:
    """Strings ``data[bounds[i]:bounds[i + 1]]`` and the suffixes they hold.

    Suffixes are numbered: first one end for each sequence (the empty suffix
    with a terminator of its own), then each position with a whole symbol.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        sizes = np.diff(bounds)
        phases = np.minimum(WIDTH, np.maximum(sizes - WIDTH + 1, 0))
        whole = np.maximum(sizes - WIDTH + 1, 0)
        self.ends = int(phases.sum())
        inner = in_group(whole)
        self.string = np.concatenate([np.repeat(np.arange(len(sizes)), phases), np.repeat(np.arange(len(sizes)), whole)])
        self.offset = np.concatenate([np.zeros(self.ends, np.int64), inner])
        first_end = np.cumsum(phases) - phases
        first_whole = np.cumsum(whole) - whole + self.ends
        owner = self.string[self.ends :]
        at = bounds[owner] + inner
        hashes = SubstringHash(data)(at, at + WIDTH) if len(at) else np.zeros(0, np.uint64)
        _, rank = np.unique(hashes, return_inverse=True)
        n = self.ends + len(at)
        # the symbol at each suffix (ends: 0), the suffix that follows it, and the symbol before it (0: none)
        self.symbol = np.zeros(n, dtype=np.int64)
        self.symbol[self.ends :] = rank + 1
        last = inner + WIDTH >= whole[owner]
        self.next = np.arange(n)
        self.next[self.ends :] = np.where(last, first_end[owner] + inner % WIDTH, first_whole[owner] + inner + WIDTH)
        self.before = np.zeros(n, dtype=np.int64)
        self.before[self.next[self.ends :]] = self.symbol[self.ends :]

    def transform(self, suffixes: np.ndarray) -> np.ndarray:
        """The order of a shard's suffixes (all of some strings), by doubling."""
        local = np.full(len(self.symbol), -1)
        local[suffixes] = np.arange(len(suffixes))
        is_end = suffixes < self.ends
        follow = local[self.next[suffixes]]
        rank = np.zeros(len(suffixes), dtype=np.int64)
        rank[is_end] = np.arange(int(is_end.sum()))  # terminators differ, in the strings' order
        _, dense = np.unique(self.symbol[suffixes[~is_end]], return_inverse=True)
        rank[~is_end] = dense + int(is_end.sum())
        n = len(suffixes)
        while True:
            pair = rank * n + rank[follow]
            order = np.argsort(pair)
            ranked = pair[order]
            new = np.ones(n, dtype=bool)
            new[1:] = ranked[1:] != ranked[:-1]
            rank[order] = np.cumsum(new) - 1
            if new.all():
                return suffixes[order]
            follow = follow[follow]


def shards(collection: Collection, bounds: np.ndarray, most: int) -> list[np.ndarray]:
    """The suffixes of consecutive strings of about ``most`` bytes together."""
    owner = bounds[:-1] // most
    of = owner[collection.string]
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return np.split(order, cuts)


def merge(collection: Collection, orders: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes, block, common): the merged order refined to ``rounds``
    symbols, the number of each place's block of equal prefixes, and for each
    place the symbols it shares with the one before it (``rounds`` if more)."""
    suffixes = np.concatenate(orders)
    sizes = np.array([len(o) for o in orders])
    n, ends = len(suffixes), collection.ends
    before = collection.before[suffixes] << 32
    ends_of = np.array([int((o < ends).sum()) for o in orders])
    kind = np.uint8 if len(orders) < 256 else np.uint16 if len(orders) < 1 << 16 else np.int64
    source = np.repeat(np.arange(len(orders)), sizes).astype(kind)
    fixed = np.repeat(np.arange(len(orders)), ends_of).astype(kind)
    place = np.arange(n)
    block = np.zeros(n, dtype=np.int64)
    common = np.full(n, rounds, dtype=np.int8)
    index = np.empty(n, dtype=np.int64)
    for depth in range(rounds):
        # which of its shard's suffixes each place holds: shards keep their order
        index[np.argsort(source, kind="stable")] = place
        key = before[index] | place
        key.sort()
        came = key & _LOW
        symbol = key >> 32
        source = source[came]
        own = block[came]
        new = np.ones(n, dtype=bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (own[1:] != own[:-1])
        new[:ends] = True
        source[:ends] = fixed
        common[new & (common == rounds)] = depth
        block = np.cumsum(new) - 1
        if new.all():
            break
    index[np.argsort(source, kind="stable")] = place
    return suffixes[index], block, common


def repeated(data: np.ndarray, bounds: np.ndarray, weight: np.ndarray, length: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every substring of ``length`` bytes (a multiple of
    ``WIDTH``) that occurs twice or more; a string of weight w counts w times."""
    if length % WIDTH:
        raise ValueError(f"the length must be a multiple of {WIDTH}")
    collection = Collection(data, bounds)
    if not len(collection.symbol):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    orders = [collection.transform(s) for s in shards(collection, bounds, shard)]
    suffixes, block, _ = merge(collection, orders, length // WIDTH)
    string, offset = collection.string[suffixes], collection.offset[suffixes]
    whole = (suffixes >= collection.ends) & (offset + length <= np.diff(bounds)[string])
    often = np.bincount(block, weight[string])[block] > 1
    hit = whole & often
    order = np.lexsort((offset[hit], string[hit]))
    return string[hit][order], offset[hit][order]
