"""Collinearity, residual normality and paired comparison of models."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, functions as F

from regiotally.functions.normal import inverse_normal, normal_below
from regiotally.functions.numeric import band_label
from regiotally.functions.pvalues import LAST_WEIGHT, NEXT_WEIGHT, kolmogorov_p, polynomial, shapiro_p, student_p
from regiotally.operators.position import with_position
from regiotally.operators.stats import pearson

# Report wording and limits.
VIF_BANDS = [(50.0, "High"), (10.0, "Elevated")]
SIGNIFICANCE = 0.05


def inflation_factors(df: DataFrame, features) -> DataFrame:
    """Variance inflation of each feature regressed on the others, without an added intercept.

    The cross products come from one aggregate. Where the other features span a constant the total sum
    of squares is taken about the mean; an exact linear combination reports infinity.
    """
    p = len(features)
    x = [F.col(f"`{f}`").cast("double") for f in features]
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(x[i]).alias(f"s{i}") for i in range(p)]
    sums += [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    row = df.agg(*sums).first()
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
    factors = inflation_from_sums(gram, np.array([row[f"s{i}"] for i in range(p)], dtype=float), float(row["n"]))
    table = df.sparkSession.createDataFrame(list(zip(features, factors)), "feature string, vif double")
    return table.withColumn("assessment", band_label("vif", VIF_BANDS, "Acceptable")).orderBy(
        F.col("vif").desc(), "feature"
    )


def inflation_from_sums(gram: np.ndarray, sums: np.ndarray, n: float) -> list[float]:
    factors = []
    for i in range(len(sums)):
        others = [j for j in range(len(sums)) if j != i]
        inner, cross = gram[np.ix_(others, others)], gram[others, i]
        unit = np.sqrt(np.where(np.diag(inner) > 0, np.diag(inner), 1.0))
        inverse = np.linalg.pinv(inner / np.outer(unit, unit), rcond=1e-12)
        left = gram[i, i] - (cross / unit) @ inverse @ (cross / unit)
        constant_left = n - (sums[others] / unit) @ inverse @ (sums[others] / unit)
        whole = gram[i, i] - sums[i] ** 2 / n if constant_left <= 1e-9 * n else gram[i, i]
        factors.append(math.inf if left <= 1e-10 * gram[i, i] else float(whole / left))
    return factors


def quantile_plot(df: DataFrame, value: str, ties) -> DataFrame:
    """Normal quantile-quantile table: ordered values against normal scores of their positions. Nulls are left out."""
    known = df.select(value, *ties).filter(F.col(value).isNotNull())
    placed, rows = with_position(known, [value, *ties], "position")
    end = 0.5 ** (1.0 / max(rows, 1))
    level = (
        F.when(F.col("position") == rows, F.lit(end))
        .when(F.col("position") == 1, F.lit(1 - end))
        .otherwise((F.col("position") - 0.3175) / (rows + 0.365))
    )
    return placed.select(
        "position", level.alias("level"), inverse_normal(level).alias("theoretical"), F.col(value).alias("ordered")
    )


def quantile_line(plot: DataFrame) -> DataFrame:
    """Slope, intercept and correlation of the line through a quantile-quantile table."""
    return plot.agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        pearson("ordered", "theoretical").alias("r"),
    )


def kolmogorov_smirnov(df: DataFrame, value: str, ties, mean: float | None = None, deviation: float | None = None) -> DataFrame:
    """One-sample Kolmogorov-Smirnov test against a normal distribution, for any number of rows, as one row.

    The distance is the largest gap between the normal distribution and the steps of the values, from numbered rows and
    one aggregate. ``mean`` and ``deviation`` of None are those of the values; the p-value is then too large, as the
    distribution was fitted to them. Nulls are left out; no rows or values that are all alike have no test (null).
    """
    known = df.select(F.col(value).cast("double").alias("_value"), *ties).filter(F.col("_value").isNotNull())
    placed, n = with_position(known, ["_value", *ties], "_position")
    fitted = known.agg(F.avg("_value").alias("mean"), F.stddev_samp("_value").alias("deviation")).first()
    centre = fitted["mean"] if mean is None else mean
    spread = fitted["deviation"] if deviation is None else deviation
    schema = "n long, distance double, p_value double, normality string"
    if not n or not spread:
        return df.sparkSession.createDataFrame([(n, None, None, None)], schema)
    below = normal_below((F.col("_value") - centre) / spread)
    gap = F.greatest(F.col("_position") / n - below, below - (F.col("_position") - 1) / n)
    distance = placed.agg(F.max(gap)).first()[0]
    p = kolmogorov_p(distance, n)
    return df.sparkSession.createDataFrame([(n, distance, p, "not rejected" if p > SIGNIFICANCE else "rejected")], schema)


def shapiro_wilk(df: DataFrame, value: str, ties) -> DataFrame:
    """Shapiro-Wilk W, its p-value and the decision at 0.05, as one row.

    Nulls are left out; values that are all alike give W = 1 and p = 1. The weights follow Royston's approximation. Only the two outermost on each side differ from scaled
    normal scores, so one aggregate over the numbered rows gives all the sums W is made of.
    """
    known = df.select(value, *ties).filter(F.col(value).isNotNull())
    placed, n = with_position(known, [value, *ties], "_position")
    if n < 3:
        raise ValueError("at least three rows are needed")
    score = inverse_normal((F.col("_position") - 0.375) / (n + 0.25))
    edge = 1 if n <= 5 else 2
    inside = (F.col("_position") > edge) & (F.col("_position") <= n - edge)
    sums = placed.withColumn("_score", score).agg(
        F.sum(F.col("_score") * F.col("_score")).alias("squares"),
        F.sum(F.when(inside, F.col("_score") * F.col(value))).alias("inner"),
        (F.var_pop(value) * n).alias("spread"),
        (F.min(value) == F.max(value)).alias("alike"),
        *[F.max(F.when(F.col("_position") == k, F.col(value))).alias(f"low{k}") for k in range(1, edge + 1)],
        *[F.max(F.when(F.col("_position") == n + 1 - k, F.col(value))).alias(f"high{k}") for k in range(1, edge + 1)],
    )
    row = sums.first()
    scores = [-NormalDist().inv_cdf((k - 0.375) / (n + 0.25)) for k in range(1, edge + 1)]
    if n == 3:
        outer = [math.sqrt(0.5)]
        inner = 0.0
    else:
        length, step = math.sqrt(row["squares"]), 1 / math.sqrt(n)
        outer = [polynomial(c, step) + s / length for c, s in zip([LAST_WEIGHT, NEXT_WEIGHT], scores)]
        rest = row["squares"] - 2 * sum(s * s for s in scores)
        inner = (row["inner"] or 0.0) / math.sqrt(rest / (1 - 2 * sum(a * a for a in outer)))
    weighted = inner + sum(a * (row[f"high{k}"] - row[f"low{k}"]) for k, a in enumerate(outer, 1))
    w = 1.0 if row["alike"] else min(weighted**2 / row["spread"], 1.0)
    p = 1.0 if row["alike"] else shapiro_p(w, n)
    return df.sparkSession.createDataFrame(
        [(n, w, p, "not rejected" if p > SIGNIFICANCE else "rejected")],
        "n long, w double, p_value double, normality string",
    )


def paired_t(df: DataFrame, errors: dict[str, str]) -> DataFrame:
    """Paired t statistic of the absolute errors of every two models, in the order given.

    The errors of a row sit side by side, so all pairs come from one aggregate without a self-join.
    """
    names = list(errors)
    pairs = list(combinations(names, 2))
    sums = []
    for i, (a, b) in enumerate(pairs):
        gap = F.abs(errors[a]) - F.abs(errors[b])
        sums += [F.avg(gap).alias(f"m{i}"), F.stddev_samp(gap).alias(f"s{i}"), F.count(gap).alias(f"n{i}")]
    cells = [
        F.struct(
            F.lit(a).alias("model_a"),
            F.lit(b).alias("model_b"),
            F.col(f"n{i}").alias("n"),
            F.try_divide(F.col(f"m{i}"), F.col(f"s{i}") / F.sqrt(F.col(f"n{i}").cast("double"))).alias("t_stat"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*sums).select(F.inline(F.array(*cells)))


def paired_t_test(df: DataFrame, errors: dict[str, str]) -> DataFrame:
    """``paired_t`` with p-values and decisions; one row per pair of models passes the driver."""
    rows = []
    for r in paired_t(df, errors).collect():
        p = student_p(r["t_stat"], r["n"] - 1) if r["t_stat"] is not None else None
        rejected = None if p is None else p < SIGNIFICANCE
        rows.append((r["model_a"], r["model_b"], r["n"], r["t_stat"], p, rejected))
    schema = "model_a string, model_b string, n long, t_stat double, p_value double, significant boolean"
    return df.sparkSession.createDataFrame(rows, schema)
