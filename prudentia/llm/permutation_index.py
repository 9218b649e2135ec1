"""Nearest neighbours by inner product through a permutation index.

Every vector is represented by its pivots, nearest first.  Each pivot's inverted
file posts the vectors by the place that the pivot has with them.  A query reads
the files of the nearer half of its own pivots, and of each only the stretch of
places within ``WINDOW`` of its own place, and sums, per vector met there, how
much nearer than ``WINDOW`` the places are; vectors not met count as that far
off.  That is the footrule distance with differences cut at the window.  The
vectors nearest by it are candidates, and exact inner products rank them.

Largest inner product becomes nearest direction by one more component: vectors
are scaled into the unit ball and lifted onto the sphere, queries get 0 there.
The index is cut into shards; queries visit every shard in blocks, and only a
shard's best leave it.  Equal vectors are one entry with their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prudentia.llm.storage import written

#: Pivots, fitted on a sample of that many vectors of each dimension.
PIVOTS = 192
#: Nearest pivots whose files a query reads, and how far from its own places.
READ, WINDOW = 96, 48
#: The share of a shard's entries that exact products rank; the least number.
RERANKED, LEAST = 0.3, 300
#: Entries of a shard and queries of a block.
SHARD_ROWS, BLOCK_ROWS = 8192, 1024


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v): rows with an id whose vector is neither null, empty nor zero
    and has finite components only; ``v`` is array<double>."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), v.alias("v")).where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(class, dim, v, ids): each different vector once, with its k + 1 smallest
    ids, which are all that can be among the k nearest of anything."""
    keyed = rows.select("id", "v", F.xxhash64("v").alias("ha"), F.xxhash64(F.lit(1), "v").alias("hb"))
    place = F.dense_rank().over(W.partitionBy("ha", "hb").orderBy("id"))
    few = keyed.withColumn("_place", place).where(F.col("_place") <= k + 1)
    lead = F.max(F.when(F.col("_place") == 1, F.col("v")))
    grouped = few.groupBy("ha", "hb").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min("id").alias("class"), lead.alias("v"))
    return grouped.select("ha", "hb", "class", F.size("v").alias("dim"), "v", "ids")


class Pivots:
    """Pivots of one dimension, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, largest: float):
        self.largest = largest
        self.lifted = self.lift(sample)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        small = vectors / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (small * small).sum(axis=1)))
        return np.concatenate([small, rest[:, None]], axis=1)

    def nearest(self, lifted: np.ndarray) -> np.ndarray:
        """The nearest pivots in order, ties by number."""
        near = lifted @ self.lifted.T
        return np.argsort(-near, axis=1, kind="stable").astype(np.uint8)

    def of_vectors(self, vectors: np.ndarray) -> np.ndarray:
        return self.nearest(self.lift(vectors))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(queries, axis=1, keepdims=True)
        return self.nearest(np.concatenate([queries / norm, np.zeros((len(queries), 1))], axis=1))


def fit(entries: DataFrame, seed: int = 0) -> dict[int, Pivots]:
    """Pivots for each dimension: ``PIVOTS`` different vectors of least seeded
    hash.  That many rows a dimension, and the largest norm, come to the driver."""
    dice = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64(F.lit(seed), "ha", "hb"), "class"))
    sample = entries.select("dim", "v", "ha", "hb", "class").withColumn("_place", dice).where(F.col("_place") <= PIVOTS).select("dim", "v", "_place").collect()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    largest = {r.dim: r.most for r in entries.groupBy("dim").agg(F.max(norm).alias("most")).collect()}
    by_dim: dict[int, list] = {}
    for r in sorted(sample, key=lambda r: r["_place"]):
        by_dim.setdefault(r.dim, []).append(r.v)
    return {dim: Pivots(np.array(v), largest[dim] * (1 + 1e-12)) for dim, v in by_dim.items()}


def _packed(rows: DataFrame, pivots: dict[int, Pivots], size: int, queries: bool, names: tuple[str, str]) -> DataFrame:
    """Rows packed into arrays, about ``size`` to a pack: (dim, pack number,
    classes, vectors, nearest pivots), all binary, ordered by class."""
    total = rows.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(size)).alias("packs"))
    dealt = rows.join(F.broadcast(total), "dim").withColumn("pack", F.pmod(F.xxhash64(F.lit(5), "class"), F.col("packs")))  # a row per dimension

    def pack(batches) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}

        def out(key) -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held[key]])
            v = np.concatenate([x[1] for x in held[key]])
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            near = (pivots[key[0]].of_queries if queries else pivots[key[0]].of_vectors)(v)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, v, near)]], ["dim", "pack", "packs", "ids", "v", "near"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, number, packs, ids = (batch.column(c).to_numpy() for c in ("dim", "pack", "packs", "class"))
            new = np.flatnonzero((dim[1:] != dim[:-1]) | (number[1:] != number[:-1])) + 1
            cuts = [0, *new.tolist(), len(dim)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = int(dim[a]), int(number[a]), int(packs[a])
                if last is not None and key != last:
                    yield out(last)
                    del held[last]
                last = key
                v = batch.column("v").slice(a, b - a).flatten().to_numpy().reshape(b - a, key[0])
                held.setdefault(key, []).append((ids[a:b], v))
        if last is not None:
            yield out(last)

    packed = dealt.select("dim", "pack", "packs", "class", "v").repartition("dim", "pack").sortWithinPartitions("dim", "pack").mapInArrow(pack, "dim int, pack long, packs long, ids binary, v binary, near binary")
    a, b = names
    return written(packed.select("dim", F.col("pack").alias(a), F.col("packs").alias(f"{a}s"), *[F.col(c).alias(f"{b}_{c}") for c in ("ids", "v", "near")]), "packed")


class Shard:
    """The inverted files of a shard's entries: for each pivot the entries in
    order of the place it has with them, and where each place begins."""

    def __init__(self, near: np.ndarray):
        self.n, self.pivots = near.shape
        place = np.empty((self.pivots, self.n), dtype=np.uint8)
        place[near.ravel(), np.repeat(np.arange(self.n), self.pivots)] = np.tile(np.arange(self.pivots, dtype=np.uint8), self.n)
        self._of_entries = place
        self._posted = np.argsort(place, axis=1, kind="stable").astype(np.int32)
        self._places = np.take_along_axis(place, self._posted, axis=1)
        self._begin = np.stack([np.searchsorted(row, np.arange(self.pivots + 1)) for row in self._places])

    def stretches(self, near: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(pivot, the query's place of it, begin, end) of what a query reads."""
        out = []
        for j, p in enumerate(near[:READ].tolist()):
            a, b = self._begin[p, max(0, j - WINDOW)], self._begin[p, min(self.pivots, j + WINDOW + 1)]
            out.append((p, j, int(a), int(b)))
        return out

    def nearness(self, near: np.ndarray) -> np.ndarray:
        """For every entry, the sum over what the query reads of how much less
        than ``WINDOW`` + 1 the places differ."""
        # all places of the files read, a byte each: cheaper than gathering stretches
        own = np.arange(min(READ, self.pivots), dtype=np.uint8)[:, None]
        places = self._of_entries[near[:READ]]
        apart = np.minimum(np.maximum(places, own) - np.minimum(places, own), np.uint8(WINDOW + 1))
        return len(own) * (WINDOW + 1) - np.add.reduce(apart, axis=0, dtype=np.int32)

    def candidates(self, near: np.ndarray) -> np.ndarray:
        most = max(LEAST, int(RERANKED * self.n))
        if most >= self.n:
            return np.arange(self.n)
        key = -self.nearness(near).astype(np.int64) * self.n + np.arange(self.n)
        return np.sort(np.argpartition(key, most)[:most])


def search(vectors: DataFrame, queries: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k``
    nearest rows of ``vectors`` other than itself (all, if fewer), by largest
    inner product in double precision, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do null ids.  Only vectors of one dimension are compared.
    Rows with equal id and vector count once; a row never finds its own id.
    Empty tables give an empty result.
    """
    rows = usable(vectors, ident, vector)
    entries = written(classes(rows, k), "entries")
    asked = usable(queries, ident, vector).distinct().select("id", F.xxhash64("v").alias("ha"), F.xxhash64(F.lit(1), "v").alias("hb"), "v")
    asked = written(asked, "asked")
    wanted = asked.groupBy("ha", "hb").agg(F.min("id").alias("class"), F.max("v").alias("v")).withColumn("dim", F.size("v"))
    pivots = fit(entries)
    shards = _packed(entries, pivots, SHARD_ROWS, False, ("shard", "s"))
    blocks = _packed(wanted, pivots, BLOCK_ROWS, True, ("block", "q"))
    visits = blocks.join(F.broadcast(shards.select("dim", "shards").distinct()), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")  # a row per dimension
    pairs = visits.join(shards.drop("shards"), ["dim", "shard"]).repartition("dim", "shard", "block")

    def visit(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                read = lambda c, kind, i=i, batch=batch: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                ids, own = read("s_ids", np.int64), read("s_v", np.float64).reshape(-1, dim)
                shard = Shard(read("s_near", np.uint8).reshape(len(ids), -1))
                who, ask = read("q_ids", np.int64), read("q_v", np.float64).reshape(-1, dim)
                near = read("q_near", np.uint8).reshape(len(who), -1)
                found = []
                for q in range(len(who)):
                    at = shard.candidates(near[q])
                    score = own[at] @ ask[q]
                    best = np.lexsort((ids[at], -score))[: k + 1]
                    found.append((np.full(len(best), who[q]), ids[at][best], score[best]))
                if found:
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.float64())], ["q", "class", "score"])

    hits = pairs.mapInArrow(visit, "q long, class long, score double")
    # the k + 1 best classes hold the k + 1 best rows; ids are put in after that
    by_class = W.partitionBy("q").orderBy(F.col("score").desc(), "class")
    hits = hits.withColumn("_place", F.row_number().over(by_class)).where(F.col("_place") <= k + 1).drop("_place")
    hits = hits.join(entries.select("class", "ids"), "class")
    by_row = W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    listed = hits.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("_place", F.row_number().over(by_row)).where(F.col("_place") <= k + 1)
    lists = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_down"), "vec_id", "score"))).alias("found"))  # k + 1 at most
    named = asked.join(wanted.select("ha", "hb", F.col("class").alias("q")), ["ha", "hb"]).select(F.col("id").alias("query_id"), "q").join(lists, "q")
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = named.select("query_id", F.posexplode(own).alias("_at", "_hit"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"), F.col("_hit.score").alias("score"))
