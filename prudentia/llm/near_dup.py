"""Near-duplicate detection by a chosen-path set similarity join.

A document's set holds its distinct 5-word shingles.  Documents with equal sets
form a class; a class is joined by its smallest doc_id.  Trees branch classes by
selected minwise tokens: a node's children are the classes that agree on one
more coordinate of the minwise signature.  Nodes small enough are compared
exhaustively, on full sets; independent trees repeat this until a pair at the
threshold is missed with probability ``1 - recall`` at most, its paths through
all levels counted.

A large root node, and one that is still large at the deepest level, is compared
with one pivot.  Members linked to it are connected, need no links among each
other and leave the node; only members close to the pivot but not linked to it
(by the triangle inequality of the Jaccard distance nobody else can) are still
compared with those that left, in blocks.  The rest branches on, on more
coordinates at once from level to level, so that texts which share a common
passage only fall apart.  A leaf compares sketches first, of 128 bytes a class;
pairs that may be linked are confirmed on full sets of 64-bit shingle hashes,
the most alike first, until their members are connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.llm.components import components
from prudentia.llm.storage import written
from prudentia.llm.textscan import LOWER, SubstringHash, chunks, column_bytes, give_back, in_group, mix, sums, words

U64 = np.uint64
WIDTH = 5
#: Coordinates of a sketch (a byte each) and, the first of them, of a path.
COORDINATES, PATH = 128, 40
#: Members up to which a node is compared exhaustively, by sketches first.
LEAF = 1024
#: Members of a block where large sets of members are compared.
BLOCK = 256
#: How often a large node branches at each level, on so many coordinates each.
LEVELS = ((2, 2), (3, 3), (3, 3))
#: Standard deviations that a sketch's estimate may fall short by chance.
SIGMAS = 5.0
_RNG = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): all shingles of each text, repeats included.

    ASCII letters are lower-cased.  A text of 1 to 4 words has one shingle, all
    of them; a text without words has none.
    """
    data = LOWER[data]
    starts, ends, first_word = words(data, offsets)
    word = np.append(SubstringHash(data).strings(starts, ends), np.zeros(WIDTH, np.uint64))
    count = np.diff(first_word)
    n = np.where(count > 0, np.maximum(count - (WIDTH - 1), 1), 0)
    at = np.repeat(first_word[:-1], n) + in_group(n)
    end = np.repeat(first_word[1:], n)
    gram = np.zeros(len(at), dtype=np.uint64)
    for k in range(WIDTH):
        gram = gram * U64(0xD1342543DE82EF95) + np.where(at + k < end, word[at + k], U64(0))
    return mix(gram + np.minimum(end - at, WIDTH).astype(np.uint64)), np.concatenate([[0], np.cumsum(n)])


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted, and where each text begins."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(first) - 1))])


def summaries(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, path, sketch): ``set_a`` and ``set_b``
    together identify the set, ``path`` has its first minwise coordinates and
    ``sketch`` a byte of each."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, 1 << 20):
            hashes, first = distinct(*shingles(*column_bytes(part.column(text))))
            n = np.diff(first)
            signature = np.zeros((part.num_rows, COORDINATES), dtype=np.int32)
            filled = n > 0
            if filled.any():
                begins = first[:-1][filled]
                for k in range(COORDINATES):
                    own = ((hashes * _FACTORS[k] + _SHIFTS[k]) >> U64(33)).astype(np.int32)
                    signature[filled, k] = np.minimum.reduceat(own, begins)
            a, b = (sums(mix(hashes ^ salt), first).astype(np.int64) for salt in (U64(0x1234567), U64(0x89ABCDEF)))
            bounds = np.arange(0, (part.num_rows + 1) * PATH, PATH, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.ascontiguousarray(signature[:, :PATH]).ravel()))
            bytes_ = pa.array([x.tobytes() for x in (signature & 255).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(ident), pa.array(n, pa.int64()), pa.array(a), pa.array(b), lists, bytes_], ["doc_id", "n_shingles", "set_a", "set_b", "path", "sketch"])

    rows = docs.select(F.col(ident).cast("long").alias(ident), F.col(text).alias(text))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, path array<int>, sketch binary")


def sets_of(docs: DataFrame, wanted: DataFrame, ident: str, text: str) -> DataFrame:
    """(class, members): the sorted shingles of the wanted classes, 8 bytes
    each.  Only texts that are wanted get scanned again."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, 1 << 20):
            hashes, first = distinct(*shingles(*column_bytes(part.column(text))))
            made = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(first * 8), pa.py_buffer(hashes)])
            yield pa.RecordBatch.from_arrays([part.column("class"), made.cast(pa.binary())], ["class", "members"])

    rows = docs.select(F.col(ident).cast("long").alias("class"), F.col(text).alias(text)).join(wanted.select("class").distinct(), "class")
    return written(rows.mapInArrow(run, "class long, members binary"), "sets")


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Forest:
    def __init__(self):
        self._up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self._up.get(x, x)) != x:
            self._up[x] = self._up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        self._up[self.root(a)] = self.root(b)


def _groups(batches, key: str) -> Iterator[pa.Table]:
    """The consecutive rows of each key, for input sorted by it; memory goes back
    after the last."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        if held:
            whole = pa.concat_tables([*held, whole])
        keys = whole.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        for cut in cuts.tolist():
            yield whole.slice(at, cut - at)
            at = cut
        held = [whole.slice(at)]
    if held:
        yield held.pop()
    whole = None
    give_back()


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _close_pairs(sketch: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bytes in common) of all pairs of rows that share ``need`` bytes."""
    found = [(np.zeros(0, np.int64),) * 3]
    for i in range(len(sketch) - 1):
        same = np.count_nonzero(sketch[i + 1 :] == sketch[i], axis=1)
        near = np.flatnonzero(same >= need)
        if len(near):
            found.append((np.full(len(near), i), near + i + 1, same[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _promising(leaves: DataFrame, need: int) -> DataFrame:
    """(list, class): from (node, class, sketch), the members of each leaf that
    chains of alike sketches connect, a list for each chain; equal lists once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        lists: dict[bytes, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            sizes = [len(x) for x in lists.values()]
            names = np.repeat(np.array([hash(k) for k in lists], dtype=np.int64), sizes)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(list(lists.values())))], ["list", "class"])

        for group in _groups(batches, "node"):
            ids = group.column("class").to_numpy()
            left, right, _ = _close_pairs(_sketches(group.column("sketch")), need)
            forest = _Forest()
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                forest.join(i, j)
            chains: dict[int, list[int]] = {}
            for i in np.unique(np.concatenate([left, right])).tolist():
                chains.setdefault(forest.root(i), []).append(i)
            for own in chains.values():
                kept = np.sort(ids[own])
                lists[kept.tobytes()] = kept
            if len(lists) >= 20_000:
                yield out()
                lists.clear()
        if lists:
            yield out()

    sorted_rows = leaves.repartition("node").sortWithinPartitions("node")
    found = sorted_rows.mapInArrow(run, "list long, class long")
    named = found.groupBy("list").agg(F.array_sort(F.collect_set("class")).alias("classes"))  # LEAF classes at most
    return named.select("classes").distinct().select(F.xxhash64("classes").alias("list"), F.explode("classes").alias("class"))


def _leaf_links(lists: DataFrame, sets: DataFrame, percent: int, need: int) -> DataFrame:
    """Links that connect what is linked in each list (list, class, sketch),
    compared on full sets, the most alike sketches first."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "list"):
            ids = group.column("class").to_pylist()
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("members")]
            left, right, same = _close_pairs(_sketches(group.column("sketch")), need)
            order = np.argsort(-same, kind="stable")
            forest, found = _Forest(), []
            for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
                if forest.root(i) != forest.root(j) and linked(own[i], own[j], percent):
                    forest.join(i, j)
                    found.append((ids[i], ids[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = lists.join(sets, "class").repartition("list").sortWithinPartitions("list", "class")
    return rows.mapInArrow(run, "a long, b long")


def _with_pivot(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, class, similarity) of distinct pairs (pivot, class)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [alike(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch.column("members"), batch.column("pivot_members"), strict=True)]
            both = [linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), batch.column("percent")[0].as_py()) for a, b in zip(batch.column("members"), batch.column("pivot_members"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("class"), pa.array(value, pa.float64()), pa.array(both, pa.bool_())], ["pivot", "class", "similarity", "linked"])
        give_back()

    joined = pairs.join(sets, "class").join(sets.select(F.col("class").alias("pivot"), F.col("members").alias("pivot_members")), "pivot")
    return joined.mapInArrow(run, "pivot long, class long, similarity double, linked boolean")


def _blocks(rows: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """(node, block, classes and sets of the block) of (node, class)."""
    sized = rows.groupBy("node").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("_blocks"))
    dealt = rows.join(sized, "node").withColumn("_block", F.pmod(F.xxhash64("class"), F.col("_blocks")))
    return dealt.join(sets, "class").groupBy("node", "_block").agg(F.collect_list(F.struct("class", "members")).alias(side)).drop("_block")


def _block_links(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int, joined: bool) -> DataFrame:
    """For each left member of a node, a link to one right member of every
    block with a linked one, compared on full sets.  ``joined``: the right
    members of a node are connected already."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for side in ("left", "right"):
                    items = batch.column(side)[row].values
                    members = items.field("members")
                    sides.append([(c, np.frombuffer(members[i].as_buffer(), np.uint64)) for i, c in enumerate(items.field("class").to_pylist())])
                found, forest = [], _Forest()
                for b, _ in sides[1] if joined else []:
                    forest.join(b, sides[1][0][0])
                for a, own in sides[0]:
                    for b, other in sides[1]:
                        if forest.root(a) != forest.root(b) and linked(own, other, percent):
                            forest.join(a, b)
                            found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        give_back()

    return _blocks(left, sets, "left").join(_blocks(right, sets, "right"), "node").select("left", "right").mapInArrow(run, "a long, b long")


def _close(pairs: DataFrame, least: int) -> DataFrame:
    """(pivot, class) of the pairs whose sketches agree in ``least`` bytes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, other = (_sketches(batch.column(c)) for c in ("sketch", "pivot_sketch"))
                near = np.flatnonzero((own == other).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(near)) for c in ("pivot", "class")], ["pivot", "class"])
        give_back()

    return pairs.select("pivot", "class", "sketch", "pivot_sketch").mapInArrow(run, "pivot long, class long")


def trees_for(similarity: float, recall: float) -> int:
    """How many trees find a pair of this similarity with this probability,
    if its nodes are large on all levels."""
    below = 1.0
    for branches, width in reversed(LEVELS):
        below = 1 - (1 - similarity**width * below) ** branches
    return min(PATH, math.ceil(math.log(1 - recall) / math.log(1 - similarity * below)))


class _Join:
    """The join of one set of documents: what its levels have in common."""

    def __init__(self, docs: DataFrame, classes: DataFrame, ident: str, text: str, percent: int):
        self._docs, self._classes, self._ident, self._text, self._percent = docs, classes, ident, text, percent
        self._threshold = percent / 100
        self._border = max(0.0, 2 * self._threshold - 1)  # nobody further from the pivot has a link to its members
        self.links: list[DataFrame] = []

    def _floor(self, similarity: float, sigmas: float) -> int:
        return math.ceil(COORDINATES * max(0.0, similarity - sigmas * math.sqrt(similarity * (1 - similarity) / COORDINATES)))

    def _border_floor(self) -> int:
        """Bytes in which a sketch agrees with the pivot's, if its class can
        have a link to one that is linked to the pivot."""
        return self._floor(self._border, SIGMAS)

    def without_star(self, large: DataFrame) -> DataFrame:
        """(node, class) of large nodes (node, class, pivot) without what is
        linked to their pivots; the links that settle the others are noted."""
        pairs = large.where("class <> pivot").select("pivot", "class").distinct()
        sketched = self._classes.select("class", "sketch")
        both = pairs.join(sketched, "class").join(sketched.select(F.col("class").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
        near = written(_close(both, self._border_floor()), "near")
        sets = sets_of(self._docs, near.select("class").union(near.select(F.col("pivot").alias("class"))), self._ident, self._text)
        measured = written(_with_pivot(near.withColumn("percent", F.lit(self._percent)), sets), "measured")
        self.links.append(measured.where("linked").select(F.col("pivot").alias("a"), F.col("class").alias("b")))
        # those near the pivot against those linked to it
        between = measured.where(f"NOT linked AND similarity >= {self._border}").select(F.col("pivot").alias("node"), "class")
        if not between.isEmpty():
            members = measured.where("linked").select(F.col("pivot").alias("node"), "class").join(between.select("node").distinct(), "node", "left_semi")
            self.links.append(written(_block_links(between, members, sets, self._percent, True), "between"))
        linked_pairs = measured.where("linked").select("pivot", "class")
        return written(large.where("class <> pivot").select("node", "class", "pivot").join(linked_pairs, ["pivot", "class"], "left_anti").select("node", "class"), "rest")

    def branched(self, rows: DataFrame, level: int) -> DataFrame:
        """The children of nodes (node, class)."""
        branches, width = LEVELS[level]
        places = [[F.pmod(F.xxhash64("node", F.lit(f"{level}/{k}/{i}")), F.lit(PATH)).cast("int") for i in range(width)] for k in range(branches)]
        keys = [F.xxhash64("node", F.lit(k), *[F.element_at("path", p + 1) for p in own]) for k, own in enumerate(places)]
        return rows.join(self._classes.select("class", "path"), "class").select(F.explode(F.array(*keys)).alias("node"), "class").distinct()

    def sized(self, nodes: DataFrame) -> DataFrame:
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("class").alias("pivot")).where("n > 1")
        return written(nodes.join(sizes, "node"), "nodes")

    def run(self, recall: float) -> DataFrame:
        trees = trees_for(self._threshold, recall)
        roots = F.posexplode(F.slice("path", 1, trees)).alias("tree", "token")
        nodes = self.sized(self._classes.select("class", roots).select(F.xxhash64("tree", "token").alias("node"), "class").distinct())
        leaves = [nodes.where(F.col("n") <= LEAF).select("node", "class")]
        large = nodes.where(F.col("n") > LEAF)
        for level in range(len(LEVELS) + 1):
            if large.isEmpty():
                break
            last = level == len(LEVELS)
            if level == 0 or last:  # what is left may be small now
                nodes = self.sized(self.without_star(large).withColumn("node", F.xxhash64("node", F.lit("rest"))))
                leaves.append(nodes.where(F.col("n") <= LEAF).select("node", "class"))
                large = nodes.where(F.col("n") > LEAF)
            if last:
                again = large.select("node", "class")
                if not again.isEmpty():
                    own = sets_of(self._docs, again, self._ident, self._text)
                    self.links.append(written(_block_links(again, again, own, self._percent, False), "blocks"))
                break
            nodes = self.sized(self.branched(large.select("node", "class"), level))
            leaves.append(nodes.where(F.col("n") <= LEAF).select("node", "class"))
            large = nodes.where(F.col("n") > LEAF)
        every = leaves[0]
        for more in leaves[1:]:
            every = every.union(more)
        need, sketched = self._floor(self._threshold, SIGMAS), self._classes.select("class", "sketch")
        lists = written(_promising(every.join(sketched, "class"), need), "lists")
        sets = sets_of(self._docs, lists, self._ident, self._text)
        out = written(_leaf_links(lists.join(sketched, "class"), sets, self._percent, need), "links")
        for more in self.links:
            out = out.union(more)
        return out


def class_links(docs: DataFrame, classes: DataFrame, ident: str, text: str, percent: int, recall: float) -> DataFrame:
    """(a, b): links between classes (class, path, sketch) that connect all that
    are linked by chains of similar pairs."""
    return _Join(docs, classes, ident, text, percent).run(recall)


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = 85, recall: float = 1 - 1e-7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked if 100 * common shingles >= percent * all shingles of
    the two; ``component_id`` is the smallest doc_id that links lead to and
    ``kept`` is whether that is the document's own.  Texts without words (null
    ones too) have 0 shingles and no links.  Rows with the same doc_id count as
    one document with the links of all its texts; a null doc_id gets a null
    component and is not kept.  An empty table gives an empty result.
    """
    info = written(summaries(docs, ident, text), "summaries")
    usable = info.where("n_shingles > 0 AND doc_id IS NOT NULL")
    grouped = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class"), F.first("path").alias("path"), F.first("sketch").alias("sketch"))
    classes = written(grouped, "classes")
    links = class_links(docs, classes.select("class", "path", "sketch"), ident, text, percent, recall)
    found = components(links, "a", "b")
    of_class = classes.select("set_a", "set_b", "class").join(found, F.col("class") == F.col("vertex"), "left").select("set_a", "set_b", F.coalesce("component", "class").alias("component"))
    joined = info.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
