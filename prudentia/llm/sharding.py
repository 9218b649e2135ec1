"""Proportional stratified interleaving of rows into shards.

Within each source the rows are put into a seeded pseudo-random order.  A row
of rank r among n has the fractional rank (r + 1/2) / n.  Sorted by fractional
rank all sources advance together, so any stretch of that order, and with it
each shard, has the mixture of the whole.  The order is cut into shards whose
row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.llm.ranking import RANKING, blocks, running
from prudentia.llm.storage import aside, written


def interleave(df: DataFrame, shards: int, source: str, ident: list[str], seed: int = 0) -> DataFrame:
    """Add ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, gapless from
    0 in each shard) to the rows of ``df``.

    ``ident`` are the columns that fix a row's place in the seeded order; rows
    equal in them are interchangeable repeats and all kept.  Null sources form
    a source of their own.  An empty table gives an empty result; with fewer
    rows than shards some shards are empty.  Columns of ``df`` named ``shard`` or
    ``slot``, or as a working column, come back with ``_input`` behind their names.
    """
    df = aside(df, ["shard", "slot", *RANKING, "_dice", "_block", "_one", "_source", "_n", "_rank", "_part", "_at"], (source, *ident))
    if shards < 1:
        raise ValueError("shards must be positive")
    total = df.count()
    cut = blocks(total)
    # 60 bits that any SQL engine computes alike
    named = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ident])
    dice: Column = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")
    # the top 40 bits, as a number in 0 .. 2**40 - 1: cuts evenly into blocks
    top = F.shiftright(F.col("_dice"), 20)
    rows = df.select("*", dice.alias("_dice")).select("*", F.floor(top * F.lit(cut) / F.lit(float(1 << 40))).alias("_block"), F.lit(1).cast("long").alias("_one"))
    order = [F.col("_dice").asc(), *[F.col(c).asc() for c in ident]]
    sized = rows.groupBy(source).agg(F.sum("_one").alias("_n")).withColumnRenamed(source, "_source")
    ranked = running(rows, [source], "_block", [F.col("_block").asc(), *order], "_one", "_rank")
    part = ranked.join(sized, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_part", (F.col("_rank") + 0.5) / F.col("_n")).drop("_source", "_n", "_rank", "_block")
    placed = written(part.withColumn("_block", F.floor(F.col("_part") * cut)), "interleave")
    placed = running(placed, [], "_block", [F.col("_part").asc(), F.col(source).asc_nulls_last(), *order], "_one", "_at")
    shard = F.floor(F.expr(f"_at * {shards} div {max(total, 1)}"))
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_at") - first).cast("long")).select(*df.columns, "shard", "slot")
