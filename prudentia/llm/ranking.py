"""Distributed order statistics with DataFrame operations only.

A global or per-group rank by a window would sort each group in one task; a
source with a third of all rows makes that the whole job.  Here a row's order
key decides a *block* of bounded size: blocks are counted, the counts are summed
in block order, and rows are ranked inside their own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Columns that ``running`` works with.
RANKING = ["_total", "_earlier", "_inner", "_k0", "_k1"]
#: Rows that a block holds at about.
BLOCK_ROWS = 20_000


def running(df: DataFrame, group: list[str], block: str, order: list[Column], value: str, before: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same group that
    come earlier by (block, order).

    ``order`` has to be consistent with ``block`` and total up to rows that are
    equal in it.  Empty input gives an empty result.
    """
    keys = [*group, block]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    earlier = W.partitionBy(*group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return ranked.join(offsets, same).withColumn(before, F.col("_inner") + F.col("_earlier")).drop("_inner", "_earlier", *[f"_k{i}" for i in range(len(keys))])


def blocks(rows: int) -> int:
    """How many blocks a table of so many rows is cut into."""
    return max(1, -(-rows // BLOCK_ROWS))
