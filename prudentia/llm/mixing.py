"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap of ``max_epochs`` times its own size.  The
sought targets are ``min(cap, level * weight)`` for the one level at which they
add up to the total: clamping what is above its cap and dealing the excess out
by weight, until none is above, ends there.  Sorted by cap / weight the clamped
sources are a prefix, so running sums find the level without a loop.

Then each source is taken whole ``floor(target / size)`` times, and the rest
of its target is a seeded sample without replacement: documents in a seeded
order as long as they fit, and of the others the one that comes nearest to the
gap that is left, if that makes it smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prudentia.llm.ranking import RANKING, blocks, running
from prudentia.llm.storage import aside, written

#: Columns that ``mix`` works with.
WORKING = ["_size", "_rows", "_source", "_dice", "_block", "_before", "_whole", "_rest", "_gap", "_best", "_filler"]
#: What counts as one word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, source: str, weights: list[float]) -> DataFrame:
    """Add ``weight``: the weights in turn, sources in code point order, null
    last.  ``sources`` has one row per source."""
    place = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, size: str, max_epochs: float, share: float = 1.0) -> DataFrame:
    """Add ``target`` (double) to one row per source with ``weight`` and a size.

    Sources of size 0 get 0.  If all sources at their caps stay below the total
    asked for, all are at their caps.
    """
    cap = F.col(size) * F.lit(float(max_epochs))
    by_level = W.orderBy(F.col("_ratio").asc(), F.col(size).asc(), F.col("weight").asc())
    everything = W.partitionBy()
    s = sources.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    s = s.withColumn("_total", F.sum(size).over(everything) * F.lit(float(share)))
    below = by_level.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_clamped", F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
    s = s.withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    # the level if exactly the sources before this one were clamped
    s = s.withColumn("_level", (F.col("_total") - F.col("_clamped")) / F.col("_open"))
    # levels fall from the first source on that is not clamped
    found = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    s = s.withColumn("_found", found)
    target = F.when(F.col("_found").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_found") * F.col("weight")))
    return s.withColumn("target", target).drop("_cap", "_ratio", "_total", "_clamped", "_open", "_level", "_found")


def mix(df: DataFrame, source: str, size: str, ident: str, weights: list[float], max_epochs: float = 3.0, seed: int = 0) -> DataFrame:
    """Add ``source_size`` (long), ``target`` (double, its source's) and
    ``repeats`` (long: how often the mix takes the row) to every row of ``df``.

    ``ident`` fixes the seeded order (md5 of seed and value, then the value);
    rows equal in it and in size are interchangeable.  Null sources form one
    source, null sizes count as 0; rows of size 0 are taken as often as their
    source is taken whole.  No row is taken more than ``ceil(max_epochs)``
    times, nor any past ``max_epochs`` for a whole number.  Reruns agree.  An
    empty table gives an empty result.  Columns of ``df`` with an added name, or
    that of a working column, come back with ``_input`` behind it.
    """
    df = aside(df, ["source_size", "target", "repeats", "weight", *RANKING, *WORKING], (source, size, ident))
    rows = df.select("*", F.coalesce(F.col(size).cast("long"), F.lit(0)).cast("long").alias("_size"))
    sized = rows.groupBy(source).agg(F.sum("_size").alias("source_size"), F.count("*").alias("_rows"))
    targets = water_fill(cyclic_weights(sized, source, weights), "source_size", max_epochs)
    targets = written(targets.withColumnRenamed(source, "_source").drop("weight"), "targets")
    digits = max(1, len(f"{blocks(targets.agg(F.sum('_rows')).first()[0] or 1):x}"))
    dice = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("_dice", dice).withColumn("_block", F.substring("_dice", 1, digits))
    ordered = running(rows, [source], "_block", [F.col("_dice"), F.col(ident), F.col("_size")], "_size", "_before")
    joined = ordered.join(targets, F.col(source).eqNullSafe(F.col("_source"))).drop("_source", "_rows", "_block", "_dice")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    joined = written(joined.withColumn("_whole", whole).withColumn("_rest", F.col("target") - whole * F.col("source_size")), "ordered")
    # documents in order while they fit, then the one that fits the gap best
    fits = (F.col("_before") + F.col("_size") <= F.col("_rest")) & (F.col("_size") > 0)
    gaps = joined.groupBy(F.col(source).alias("_source")).agg((F.max("_rest") - F.sum(F.when(fits, F.col("_size")).otherwise(F.lit(0)))).alias("_gap"))
    same = F.col(source).eqNullSafe(F.col("_source"))
    off = F.abs(F.col("_size") - F.col("_gap"))
    best = joined.join(gaps, same).where(~fits & (F.col("_size") > 0) & (off < F.col("_gap"))).groupBy("_source").agg(F.min(F.struct(off.alias("off"), F.col("_before").alias("at"))).alias("_best"))
    taken = joined.join(best.select("_source", F.col("_best.at").alias("_filler")), same, "left")
    again = fits | F.coalesce((F.col("_before") == F.col("_filler")) & (F.col("_size") > 0), F.lit(False))
    return taken.withColumn("repeats", F.col("_whole") + again.cast("long")).select(*df.columns, "source_size", "target", "repeats")
