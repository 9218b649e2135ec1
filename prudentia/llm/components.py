"""Connected components of a link table, by alternating star contraction.

Large-star and small-star rounds hang every vertex onto smaller neighbours
until each component is a star around its smallest vertex.  All of it is joins
and aggregations; links never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.llm.storage import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links have u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(vertex, component): for every vertex with a link to a larger or smaller
    one, the smallest vertex that links lead to.  Nulls and self-links are
    ignored; smallest vertices themselves are not listed."""
    stars = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars, before = written(stars, "stars"), None
    for _ in range(rounds):
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == before:
            return stars.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
        before = tuple(now)
        if not now[0]:
            continue
        stars = written(_small_star(_large_star(stars)), "stars")
    raise RuntimeError(f"no components after {rounds} rounds")
