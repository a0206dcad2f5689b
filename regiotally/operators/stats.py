"""Distribution, correlation and trend statistics as single-pass aggregates."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F


def skew_adjusted(column: str) -> Column:
    """Skewness with the small-sample correction; null below three values or without spread."""
    n = F.count(column).cast("double")
    spread = F.max(column) > F.min(column)
    corrected = F.skewness(column) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when((n > 2) & spread, corrected)


def pearson(a: str, b: str) -> Column:
    """Correlation of the pairs without nulls; null where a column is constant, for which ``corr`` fails."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins from minimum to maximum, empty bins included, the last bin closed.

    With a single distinct value the range is widened by half a unit on both sides.
    """
    rows = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    low, high = F.min("x"), F.max("x")
    flat = low == high
    limits = rows.agg(
        F.when(flat, low - 0.5).otherwise(low).alias("low"), F.when(flat, high + 0.5).otherwise(high).alias("high")
    )
    lower, upper = F.col("_limits.low"), F.col("_limits.high")
    width = (upper - lower) / bins
    edge = lambda k: F.when(k == bins, upper).otherwise(lower + k * width)
    # rounding may put a value beside its bin: the edges decide, and the last bin is closed
    guess = F.greatest(F.least(F.floor((F.col("x") - lower) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    moved = with_row(rows, limits, "_limits").withColumn("_bin", guess)
    place = F.when(F.col("x") < edge(F.col("_bin")), F.col("_bin") - 1)
    place = place.when((F.col("x") >= edge(F.col("_bin") + 1)) & (F.col("_bin") < bins - 1), F.col("_bin") + 1)
    counts = moved.groupBy(place.otherwise(F.col("_bin")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = with_row(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), limits, "_limits")
    return every.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("from_value"),
        edge(F.col("bin") + 1).alias("to_value"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """The one row of an aggregate beside every row of ``df``, as a struct: one subquery, whatever is read from it."""
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())


#: Powers kept of the offsets in a cell of the density: with cells of half a bandwidth the rest of the series is under
#: 1e-13 of a value's kernel.
POWERS = 14


def density(df: DataFrame, column: str, points: int = 200, bins: int | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid from minimum to maximum.

    The bandwidth h is n^(-1/5) times the sample deviation; a column without spread has no density (null). Values are
    binned into cells of h/2, and one aggregate keeps ``POWERS`` sums of each cell: with t the offset from the middle of
    the cell and d the distance of a grid point from it, both in bandwidths, the kernel is exp(-d^2/2) times the sum over
    k of d^k/k! * t^k exp(-t^2/2). As t is at most 1/4, the terms left out add less than 1e-13 to the kernel of a value,
    whose largest value is 1. Cells, not values, then meet the grid. With ``bins`` a column ``curve`` scales the density
    to the counts of a histogram of so many bins.
    """
    rows = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    count = F.count("x").cast("double")
    base = rows.agg(
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        count.alias("rows"),
        F.when(F.max("x") > F.min("x"), F.stddev_samp("x") * F.pow(count, F.lit(-0.2))).alias("bandwidth"),
    )
    low, high, total, h = (F.col(f"_base.{c}") for c in ("low", "high", "rows", "bandwidth"))
    cell = F.floor((F.col("x") - low) / (h / 2))
    placed = with_row(rows, base, "_base").withColumns({"_cell": cell, "_t": (F.col("x") - low) / h - (cell + 0.5) / 2})
    placed = placed.withColumn("_w", F.exp(F.col("_t") * F.col("_t") * -0.5))
    power, sums = F.col("_w"), []
    for _ in range(POWERS):
        sums.append(F.sum(power))
        power = power * F.col("_t")
    cells = placed.filter(F.col("_cell").isNotNull()).groupBy("_cell").agg(F.array(*sums).alias("_sums"))
    met = with_row(cells.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))), base, "_base")
    at = low + F.col("point") * (high - low) / (points - 1)
    met = met.withColumn("_d", (at - low) / h - (F.col("_cell") + 0.5) / 2)
    series = F.lit(0.0)
    for k in range(POWERS - 1, 0, -1):
        series = (series + F.col("_sums")[k]) * F.col("_d") / k
    kernel = F.exp(F.col("_d") * F.col("_d") * -0.5) * (series + F.col("_sums")[0])
    summed = met.groupBy("point").agg(F.sum(kernel).alias("_kernel"))
    grid = with_row(df.sparkSession.range(points).select(F.col("id").cast("int").alias("point")), base, "_base")
    height = F.col("_kernel") / (total * h * F.sqrt(F.pi() * 2))
    out = grid.join(summed, "point", "left").withColumns({"x": at, "density": height})
    out = out if bins is None else out.withColumn("curve", F.col("density") * total * (high - low) / bins)
    return out.drop("_base", "_kernel")


def trend_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Least-squares line at evenly spaced points between the smallest and largest ``x``."""
    fit = df.agg(
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("slope"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
    )
    intercept, slope, low, high = (F.col(f"_fit.{c}") for c in ("intercept", "slope", "low", "high"))
    grid = with_row(df.sparkSession.range(points).select(F.col("id").cast("int").alias("point")), fit, "_fit")
    at = low + F.col("point") * (high - low) / (points - 1)
    return grid.select("point", at.alias("x"), (intercept + slope * at).alias("y"))


def correlation_matrix(df: DataFrame, columns, names=None) -> DataFrame:
    """Pearson correlation of every pair, in long form, from one aggregate."""
    names = names or {}
    label = {c: names.get(c, c) for c in columns}
    pairs = list(combinations_with_replacement(columns, 2))
    both = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs if a != b]
    place = {pair: f"c{i}" for i, pair in enumerate(pairs)}
    row = df.agg(*[pearson(a, b).alias(place[a, b]) for a, b in pairs])
    cells = [
        F.struct(
            F.lit(label[a]).alias("row_name"),
            F.lit(label[b]).alias("column_name"),
            F.col(place[a, b] if (a, b) in place else place[b, a]).alias("r"),
        )
        for a, b in both
    ]
    return row.select(F.inline(F.array(*cells)))


def correlation_wide(df: DataFrame, columns, names=None) -> DataFrame:
    """``correlation_matrix`` for hundreds of columns: two vector aggregates, whatever their number.

    The first finds the means, the second the Gram matrix of centred values, their squares and the marks of known values,
    which holds for every pair the sums over the rows that know both. Tasks send one packed triangle of (3p)^2 / 2
    numbers on, and the driver holds the matrix. Constant columns give null.
    """
    names = names or {}
    p, label = len(columns), [names.get(c, c) for c in columns]
    values = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x"))
    filled = F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))
    known = F.transform("x", lambda v: v.isNotNull().cast("double"))
    both = values.select(array_to_vector(F.concat(filled, known)).alias("v"))
    sums = np.zeros(2 * p) if both.isEmpty() else both.agg(Summarizer.sum(F.col("v")).alias("s")).first()["s"].toArray()
    centre = np.divide(sums[:p], sums[p:], out=np.zeros(p), where=sums[p:] > 0)
    off = F.zip_with("x", F.array(*[F.lit(float(c)) for c in centre]), lambda v, c: F.coalesce(v - c, F.lit(0.0)))
    rows = values.select(known.alias("m"), off.alias("x")).select(array_to_vector(F.concat("x", "m", F.transform("x", lambda v: v * v))).alias("v"))
    if sums[p:].any():
        gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), 0, 3 * p).computeGramianMatrix().toArray()
    else:
        gram = np.zeros((3 * p, 3 * p))
    x, m, q = slice(0, p), slice(p, 2 * p), slice(2 * p, 3 * p)
    n, sx, sxx, sxy = gram[m, m], gram[x, m], gram[q, m], gram[x, x]  # of row i, over rows that know i and j
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = sxx - sx * sx / n
        # a spread of rounding noise is none
        spread = np.where(spread <= 1e-12 * sxx, 0.0, spread)
        r = (sxy - sx * sx.T / n) / np.sqrt(spread * spread.T)
    table = [(label[i], label[j], float(r[i, j]) if np.isfinite(r[i, j]) else None) for i in range(p) for j in range(p)]
    return df.sparkSession.createDataFrame(table, "row_name string, column_name string, r double")
