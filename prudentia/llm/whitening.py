"""Whitening of embeddings by a distributed singular value decomposition.

Vectors are taken on a grid of whole numbers, so that counts, sums and squared
deviations are exact.  MLlib decomposes the matrix of the centred distinct
vectors; squared singular values over the number of rows are the eigenvalues of
the covariance.  The total variance comes from the exact deviations and not from
the decomposition (from centred doubles only where a deviation has more than 38
digits).
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prudentia.llm.storage import aside, written

#: Singular values under this share of the largest count as zero: the Gram
#: matrix in doubles doesn't tell them from rounding.
RCOND = 1e-6
_ADDED = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


@dataclass
class Whitening:
    """What the fit list says: nothing in it grows but with the dimension."""

    dims: int
    n: int
    largest: int
    sums: list[int]
    trace: float
    eigenvalues: list[float]
    components: list[list[float]]
    identity_error: float | None = None


def on_grid(vectors: DataFrame, vector: str, scale: float) -> DataFrame:
    """``vectors`` with ``_x``, the whole numbers floor(scale * entry), without the
    rows that take no part: null vectors, vectors with null or non-finite
    entries, and those of another length than most have (the longer, in a tie)."""
    entry = lambda c: c.cast("double")
    fine = F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) != float("inf"))), F.lit(False))
    usable = vectors.where(fine)
    usual = usable.groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        return usable.withColumn("_x", F.array().cast("array<bigint>"))
    return usable.where(F.size(vector) == usual["dims"]).withColumn("_x", F.transform(vector, lambda c: F.floor(entry(c) * F.lit(float(scale))).cast("bigint")))


def _dot(a: Column, b: Column, kind: str) -> Column:
    """Exact sum of products; in decimals null where 38 digits don't do."""
    if kind == "bigint":
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
    product = lambda x, y: F.try_multiply(x.cast("decimal(38,0)"), y.cast("decimal(38,0)")).cast("decimal(38,0)")
    return F.aggregate(F.zip_with(a, b, product), F.lit(0).cast("decimal(38,0)"), lambda s, x: F.try_add(s, x).cast("decimal(38,0)"))


def _whole(values: list[int], kind: str) -> Column:
    return F.array(*[_number(v).cast(kind) for v in values])


def _number(v: int) -> Column:
    """A whole number of any size; null beyond 38 digits."""
    return F.lit(str(v) if abs(v) < 10**38 else None)


def deviation(x: Column, model: Whitening) -> Column:
    """Sum over dimensions of (n x - S)^2 as decimal(38,0), by n^2 x.x - 2 n x.S + S.S
    in whole numbers; null beyond 38 digits."""
    bound = max(model.largest, 1) * max(model.largest, *map(abs, model.sums), 1) * max(model.dims, 1)
    kind = "bigint" if bound < 2**63 else "decimal(38,0)"
    whole = lambda c: c.cast("decimal(38,0)")
    times = lambda a, b: F.try_multiply(whole(a), whole(b)).cast("decimal(38,0)")
    squares = times(_dot(x, x, kind), _number(model.n * model.n))
    mixed = times(_dot(x, _whole(model.sums, kind), kind), _number(-2 * model.n))
    constant = _number(sum(s * s for s in model.sums))
    return F.try_add(F.try_add(squares, mixed), whole(constant)).cast("decimal(38,0)")


def centred(x: Column, model: Whitening) -> Column:
    means = F.array(*[F.lit(float(Fraction(s, model.n))) for s in model.sums])
    return F.zip_with(x, means, lambda a, m: a.cast("double") - m)


def projections(x: Column, model: Whitening) -> list[Column]:
    """The whitened coordinates of the vector ``x``."""
    y, out = centred(x, model), []
    for unit, e in zip(model.components, model.eigenvalues, strict=True):
        axis = F.array(*[F.lit(v) for v in unit])
        out.append(F.aggregate(F.zip_with(y, axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / F.lit(e**0.5))
    return out


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """A whitening from the distinct vectors ``_x`` of ``rows``; None for no rows.

    Equal vectors meet in partial aggregates, so a vector that a third of the
    rows share costs a row per task.  The driver gets a row per dimension and
    MLlib's Gram matrix of dims x dims.
    """
    once = written(rows.groupBy("_x").agg(F.lit(1).alias("_")).select("_x"), "fit-list")
    n = once.count()
    if not n:
        return None
    entries = once.select(F.posexplode("_x").alias("dim", "c"))
    totals = entries.groupBy("dim").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.max(F.abs(F.col("c").cast("decimal(20,0)"))).alias("m")).orderBy("dim").collect()
    model = Whitening(len(totals), n, max([0, *(int(t["m"]) for t in totals)]), [int(t["s"]) for t in totals], 0.0, [], [])
    if not totals:
        return model
    exact = deviation(F.col("_x"), model)
    near = F.aggregate(centred(F.col("_x"), model), F.lit(0.0), lambda s, c: s + c * c)
    total = once.agg(F.sum(exact).alias("exact"), F.sum(near).alias("near"), F.count_if(exact.isNull()).alias("lost")).first()
    model.trace = total["near"] / n if total["lost"] or total["exact"] is None else float(Fraction(int(total["exact"]), n**3))
    if not model.trace:
        return model
    vectors = MLUtils.convertVectorColumnsFromML(once.select(array_to_vector(centred(F.col("_x"), model)).alias("v")), "v")
    # All values are asked for: MLlib then decomposes the Gram matrix by LAPACK to
    # double precision, and not by iterations up to a tolerance.
    found = RowMatrix(vectors, n, model.dims).computeSVD(model.dims, computeU=False, rCond=RCOND)
    basis = found.V.toArray()
    for j, s in enumerate(found.s.toArray()[:components].tolist()):
        model.eigenvalues.append(s * s / n)
        model.components.append(basis[:, j].tolist())
    axes = [f"w{j}" for j in range(len(model.components))]
    placed = once.select(*[w.alias(a) for a, w in zip(axes, projections(F.col("_x"), model), strict=True)])
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[: i + 1]]
    seen = placed.agg(*[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    model.identity_error = max(abs(seen[f"{a}_{b}"] - (a == b)) for a, b in pairs)
    return model


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """A row for each row of ``vectors`` that takes part and each component.

    Added: ``component`` (from 1, by falling eigenvalue), ``n`` (distinct
    vectors), ``deviation`` (exact, null beyond 18 digits), ``whitened``,
    ``explained`` (the component's share of the total variance) and
    ``identity_error`` (of the whitened fit list's covariance, one value).  Equal
    eigenvalues' components are any basis of their space.

    Rows whose vector is null, holds null or non-finite entries, or has another
    length than most are left out.  Components without variance don't exist: a
    table of equal vectors, of one vector or of none gives no rows.  Repeated
    vectors count once in the fit and are all returned; null ids pass.  Columns
    named as added ones come back with ``_input`` behind their names.
    """
    vectors = aside(vectors, [*_ADDED, "_x"], (vector,))
    rows = written(on_grid(vectors, vector, scale), "on-grid")
    model = fit(rows, components)
    kept = [F.col(c) for c in vectors.columns]
    if model is None or not model.components:
        none = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.where("false").select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    one = lambda j, w: F.struct(F.lit(j + 1).alias("component"), w.alias("whitened"), F.lit(model.eigenvalues[j] / model.trace).alias("explained"))
    each = F.array(*[one(j, w) for j, w in enumerate(projections(F.col("_x"), model))])
    whole = deviation(F.col("_x"), model).try_cast("long")
    shown = rows.select(*kept, F.lit(model.n).cast("long").alias("n"), whole.alias("deviation"), F.explode(each).alias("_c"))
    return shown.select(*kept, "_c.component", "n", "deviation", "_c.whitened", "_c.explained", F.lit(model.identity_error).alias("identity_error"))
