"""Pairs of 64-bit fingerprints within a Hamming distance, by vantage-point trees.

A tree's node has a vantage point and a radius; fingerprints within the radius go
left, others right.  By the triangle inequality a fingerprint can have partners
beyond the boundary only if its own distance to the vantage point is within the
searched distance of the radius.  The leaves of a tree over a bounded sample are
the shards of the whole table: each fingerprint has one, and is sent as a query
to those right of a boundary it lies close to.  Shards are compared in cells of a
bounded size, again by trees, down to small nodes that are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.llm.storage import written
from prudentia.llm.textscan import give_back, mix

#: Fingerprints a shard is made for, and in a block at most on average.
SHARD, BLOCK = 8_192, 16_384
#: Fingerprints a tree is built from: so many for each shard, and at most.
FOR_SHARD, SAMPLE = 64, 1 << 20
#: Nodes of so many members are compared at once.
SMALL = 256
#: A split has to leave at most this share of a node's pairs.
WORTH = 0.97

_PACKED = "shard int, query boolean, n long, prints binary"


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def chosen(members: np.ndarray, most: int, rng: np.random.Generator, tries: int = 6) -> tuple[np.uint64, int] | None:
    """The vantage point and radius, of a few tried, that leave the fewest pairs to
    compare: those within either side and those of the inner margin with the
    outer side.  None if no split is worth while."""
    best, n = None, len(members)
    for vantage in members[rng.integers(0, n, tries)]:
        below = np.cumsum(np.bincount(distance(members, vantage), minlength=65)).astype(np.float64)
        inner = below[:64]
        outer = n - inner
        margin = inner - np.concatenate([np.zeros(min(most, 64)), below])[:64]
        cost = np.where((inner > 0) & (outer > 0), (inner**2 + outer**2) / 2 + margin * outer, np.inf)
        radius = int(np.argmin(cost))
        if best is None or cost[radius] < best[0]:
            best = cost[radius], vantage, radius
    return best[1:] if best and best[0] <= WORTH * n * n / 2 else None


@dataclass
class Tree:
    """Nodes as arrays; a child below 0 is the leaf ``~child``."""

    most: int
    vantage: list = field(default_factory=list)
    radius: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    leaves: int = 0

    @staticmethod
    def over(sample: np.ndarray, leaf: float, most: int) -> Tree:
        """A tree whose leaves hold about ``leaf`` of the sample, or what can't be
        split."""
        tree, rng = Tree(most), np.random.default_rng(7)

        def grow(part: np.ndarray) -> int:
            split = chosen(part, most, rng) if len(part) > max(leaf, 1) else None
            if split is None:
                tree.leaves += 1
                return ~(tree.leaves - 1)
            at = len(tree.vantage)
            vantage, radius = split
            for column, value in ((tree.vantage, vantage), (tree.radius, radius), (tree.left, 0), (tree.right, 0)):
                column.append(value)
            inner = distance(part, vantage) <= radius
            tree.left[at], tree.right[at] = grow(part[inner]), grow(part[~inner])
            return at

        grow(sample)
        return tree

    def routed(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, its members, queries sent to it) for each leaf that gets any."""
        todo = [(0 if self.vantage else ~0, prints, prints[:0])]
        while todo:
            at, members, queries = todo.pop()
            if not len(members) and not len(queries):
                continue
            if at < 0:
                yield ~at, members, queries
                continue
            far, query_far = distance(members, self.vantage[at]), distance(queries, self.vantage[at])
            inner, radius = far <= self.radius[at], self.radius[at]
            near = members[inner & (far.astype(np.int64) + self.most > radius)]
            todo.append((self.left[at], members[inner], queries[query_far.astype(np.int64) - self.most <= radius]))
            todo.append((self.right[at], members[~inner], np.concatenate([queries[query_far.astype(np.int64) + self.most > radius], near])))


def close(members: np.ndarray, queries: np.ndarray | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): places of all pairs within ``most`` of each other, of members with
    queries or, without queries, of members among themselves."""
    rng = np.random.default_rng(11)
    alone = queries is None
    todo = [(np.arange(len(members)), None if alone else np.arange(len(queries)))]
    other = members if alone else queries
    while todo:
        mine, theirs = todo.pop()
        asked = mine if theirs is None else theirs
        if not len(mine) or not len(asked):
            continue
        split = chosen(members[mine], most, rng, 2) if len(mine) > SMALL else None
        if split is None:
            own = members[mine]
            for k in range(0, len(asked), step := max(1, (1 << 18) // len(own))):
                part = asked[k : k + step]
                b, a = np.nonzero(distance(own[None, :], other[part][:, None]) <= most)
                if theirs is None:
                    later = b + k > a
                    a, b = a[later], b[later]
                if len(a):
                    yield mine[a], part[b]
            continue
        vantage, radius = split
        far = distance(members[mine], vantage).astype(np.int64)
        inner = far <= radius
        if theirs is None:
            todo += [(mine[inner], None), (mine[~inner], None), (mine[~inner], mine[inner & (far + most > radius)])]
        else:
            asked_far = distance(other[theirs], vantage).astype(np.int64)
            todo += [(mine[inner], theirs[asked_far - most <= radius]), (mine[~inner], theirs[asked_far + most > radius])]


class Forest:
    """Keeps, of many links, those that connect what wasn't connected."""

    def __init__(self, n: int):
        self._label = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self._label[a], self._label[b]
        new = x != y
        if not new.any():
            return
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while (up := parent.get(v, v)) != v:
                v = up
            return v

        for i, j, v, w in zip(a[new].tolist(), b[new].tolist(), x[new].tolist(), y[new].tolist(), strict=True):
            v, w = root(v), root(w)
            if v != w:
                parent[max(v, w)] = min(v, w)
                self.kept.append((i, j))
        table = np.arange(len(self._label))
        for v in sorted(parent):
            table[v] = root(v)
        self._label = table[self._label]


def cell_links(members: np.ndarray, queries: np.ndarray | None, most: int) -> np.ndarray:
    """Links (rows of two fingerprints) that connect what pairs within ``most``
    connect: fewer than there are fingerprints."""
    every = members if queries is None else np.concatenate([members, queries])
    forest, shift = Forest(len(every)), 0 if queries is None else len(members)
    for a, b in close(members, queries, most):
        forest.add(a, b + shift)
    return every[np.array(forest.kept, dtype=np.int64).reshape(-1, 2)]


def _as_prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64)


def hamming_links(prints: DataFrame, column: str, most: int) -> DataFrame:
    """(a, b): links between the distinct values of ``column`` (long, no nulls) that
    connect exactly what pairs within ``most`` bits connect.

    Each value occurs once in ``prints``.  The driver holds a tree over at most
    2**20 sampled values and a row for each of its leaves (2**14 at most).  A
    shard of any size is cut into blocks, so a task holds two blocks at a time.
    """
    spark, total = prints.sparkSession, prints.count()
    shards = max(1, min(total // SHARD + 1, SAMPLE // FOR_SHARD))
    wanted = shards * FOR_SHARD
    sampled = prints if total <= wanted else prints.where(F.pmod(F.xxhash64(column, F.lit("sample")), F.lit(total)) < wanted)
    sample = np.sort(np.array([r[0] for r in sampled.select(column).collect()], dtype=np.int64).view(np.uint64)) if shards > 1 else np.zeros(0, np.uint64)
    tree = Tree.over(sample, FOR_SHARD, most)

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(leaf, role, part) for leaf, *both in tree.routed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) for role, part in zip((False, True), both, strict=True) if len(part)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["shard", "query", "n", "prints"])

    routed = written(prints.select(column).mapInArrow(deal, _PACKED), "routed")
    blocks: dict[tuple[int, bool], int] = {(r["shard"], r["query"]): -(-r["n"] // BLOCK) for r in routed.groupBy("shard", "query").agg(F.sum("n").alias("n")).collect()}

    def cells(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bool, bytes]] = []
            for shard, query, body in zip(*[batch.column(c).to_pylist() for c in ("shard", "query", "prints")], strict=True):
                own, foreign = blocks.get((shard, False), 0), blocks.get((shard, True), 0)
                values = np.frombuffer(body, np.uint64)
                dealt = (mix(values) % np.uint64(max(1, foreign if query else own))).astype(np.int64)
                for block in range(foreign if query else own):
                    part = values[dealt == block].tobytes()
                    if not part:
                        continue
                    if query:
                        out += [(shard, i, own + block, True, part) for i in range(own)]
                    else:
                        out += [(shard, block, j, False, part) for j in range(block, own + foreign)]
                        out += [(shard, i, block, True, part) for i in range(block)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["shard", "i", "j", "query", "prints"])

    def compare(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy()
        parts = table.column("prints").combine_chunks()
        members, queries = _as_prints(parts.filter(pa.array(~query))), _as_prints(parts.filter(pa.array(query)))
        alone = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        links = cell_links(members, None if alone else queries, most)
        give_back()
        return pa.table({"a": links[:, 0].view(np.int64), "b": links[:, 1].view(np.int64)})

    dealt = routed.mapInArrow(cells, "shard int, i int, j int, query boolean, prints binary")
    return dealt.groupBy("shard", "i", "j").applyInArrow(compare, "a long, b long")
