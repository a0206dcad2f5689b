"""Linear, ridge and lasso regression.

Final models are fitted by Spark ML. Feature comparison, validation and tuning need many fits over the same
rows, so one aggregate reduces the rows to their second moments and those fits work on p-by-p sums.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

OLS, RIDGE, LASSO = "ols", "ridge", "lasso"


@dataclass(frozen=True)
class LinearFit:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    converged: bool = True  # a fit that stopped at its limit of steps says so

    def column(self, prefix: str = "z_") -> Column:
        """The prediction as plain arithmetic, so that scoring stays in generated code."""
        value = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            value = value + F.col(f"`{prefix}{name}`") * weight
        return value


def fit_rows(df: DataFrame, features, target: str, jobs, moments: "Moments", prefix: str = "z_") -> list[LinearFit]:
    """Fit one Spark ML model per ``(kind, alpha)`` job on the same rows; constant features get weight 0.

    The penalties follow the textbook objectives |y - Xw|^2 + alpha |w|_2^2 for ridge and
    |y - Xw|^2 / 2n + alpha |w|_1 for lasso. Spark's objective is scaled by 1 / 2n and by the deviation of
    the label, which the ridge parameter has to undo; both are known from the ``moments`` of the features.
    """
    varying = [f for f, varies in zip(features, moments.varies()) if varies]
    columns = [F.col(f"`{prefix}{f}`").alias(f"f{i}") for i, f in enumerate(varying)]
    named = df.select(F.col(target).cast("double").alias("label"), *columns)
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(len(varying))], outputCol="features")
    rows = assembler.transform(named).select("label", "features").persist()
    try:
        fits = []
        for kind, alpha in jobs:
            penalty = {OLS: 0.0, RIDGE: alpha * moments.target_spread() / moments.n, LASSO: alpha}[kind]
            model = LinearRegression(
                solver="normal",
                standardization=False,
                elasticNetParam=1.0 if kind == LASSO else 0.0,
                regParam=penalty,
                maxIter=10_000,
                tol=1e-12,
            ).fit(rows)
            converged = kind != LASSO or model.summary.totalIterations < 10_000
            if not converged:
                warnings.warn(f"the lasso has not converged after {model.summary.totalIterations} iterations", stacklevel=2)
            found = dict(zip(varying, (float(c) for c in model.coefficients)))
            weights = tuple(found.get(f, 0.0) for f in features)
            fits.append(LinearFit(tuple(features), weights, float(model.intercept), converged))
        return fits
    finally:
        rows.unpersist()


@dataclass(frozen=True)
class Moments:
    """Row count, sums and cross products of the features and the target."""

    n: float
    x: np.ndarray
    xx: np.ndarray
    y: float
    xy: np.ndarray
    yy: float

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(
            self.n + other.n, self.x + other.x, self.xx + other.xx,
            self.y + other.y, self.xy + other.xy, self.yy + other.yy,
        )

    def scaled(self, centre: np.ndarray, spread: np.ndarray) -> "Moments":
        """The moments of ``(x - centre) / spread``."""
        x = self.x - self.n * centre
        xx = self.xx - np.outer(self.x, centre) - np.outer(centre, self.x) + self.n * np.outer(centre, centre)
        xy = self.xy - centre * self.y
        return Moments(self.n, x / spread, xx / np.outer(spread, spread), self.y, xy / spread, self.yy)

    def only(self, places: list[int]) -> "Moments":
        """The moments of some of the features."""
        return Moments(self.n, self.x[places], self.xx[np.ix_(places, places)], self.y, self.xy[places], self.yy)

    def varies(self) -> np.ndarray:
        """Which features vary, beyond the rounding of features that are scaled to about 1."""
        square = np.diag(self.xx)
        return square - self.x**2 / self.n > 1e-12 * np.maximum(square, self.n)

    def spread(self) -> np.ndarray:
        """Population deviation per feature, 1 for a constant one."""
        variance = np.diag(self.xx) / self.n - (self.x / self.n) ** 2
        return np.where(self.varies(), np.sqrt(np.maximum(variance, 0.0)), 1.0)

    def target_spread(self) -> float:
        return float(np.sqrt(max(self.yy / self.n - (self.y / self.n) ** 2, 0.0)))

    def mean_squared_error(self, weights: np.ndarray, intercept: float) -> float:
        error = (
            self.yy - 2 * weights @ self.xy - 2 * intercept * self.y
            + weights @ self.xx @ weights + 2 * intercept * weights @ self.x + self.n * intercept**2
        )
        return max(error, 0.0) / self.n


def moments_by(df: DataFrame, features, target: str, keys, prefix: str = "z_") -> dict[tuple, Moments]:
    """One aggregate with map-side combine; groups times p-by-p sums reach the driver.

    ``keys`` are for few groups, such as folds and train or test. A null feature or target is an error.
    """
    p = len(features)
    x = [f"`{prefix}{f}`" for f in features]
    y = f"cast(`{target}` AS double)"
    gap = " OR ".join(f"{v} IS NULL" for v in [y, *x])
    sums = ["count(1) AS n", f"count_if({gap}) AS gaps", f"sum({y}) AS y", f"sum({y} * {y}) AS yy"]
    for i in range(p):
        sums += [f"sum({x[i]}) AS x{i}", f"sum({x[i]} * {y}) AS xy{i}"]
        sums += [f"sum({x[i]} * {x[j]}) AS xx{i}_{j}" for j in range(i, p)]
    found = {}
    for row in df.groupBy(*keys).agg(*[F.expr(s) for s in sums]).collect():
        if row["gaps"]:
            raise ValueError(f"{row['gaps']} rows have a null feature or target")
        xx = np.array([[row[f"xx{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
        found[tuple(row[k] for k in keys)] = Moments(
            float(row["n"]), np.array([row[f"x{i}"] for i in range(p)], dtype=float), xx,
            float(row["y"]), np.array([row[f"xy{i}"] for i in range(p)], dtype=float), float(row["yy"]),
        )
    return found


def fit_subset(m: Moments, features, subset, kind: str, alpha: float = 0.0) -> LinearFit:
    """A model on some of the features the moments cover."""
    weights, intercept = fit_moments(m.only([list(features).index(f) for f in subset]), kind, alpha)
    return LinearFit(tuple(subset), tuple(float(w) for w in weights), intercept)


def fit_moments(m: Moments, kind: str, alpha: float = 0.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from moments alone; a feature that is constant in the rows gets weight 0.

    Of all solutions for collinear features the one of the smallest norm is taken, in the scale the features have.
    The moments are p-by-p, meant for tens of features.
    """
    mean_x, mean_y = m.x / m.n, m.y / m.n
    gram = m.xx - m.n * np.outer(mean_x, mean_x)
    cross = m.xy - mean_x * m.y
    varies = np.flatnonzero(m.varies())
    weights = np.zeros(len(cross))
    gram, cross = gram[np.ix_(varies, varies)], cross[varies]
    if kind == OLS:
        weights[varies] = np.linalg.lstsq(gram, cross, rcond=1e-12)[0]
    elif kind == RIDGE:
        weights[varies] = np.linalg.solve(gram + alpha * np.eye(len(cross)), cross)
    else:
        weights[varies] = _lasso_weights(gram / m.n, cross / m.n, alpha)
    return weights, float(mean_y - weights @ mean_x)


def _lasso_weights(gram, cross, alpha, rounds: int = 10_000, tolerance: float = 1e-13):
    """Coordinate descent on the covariance form of the lasso objective."""
    weights = np.zeros(len(cross))
    for _ in range(rounds):
        before = weights.copy()
        for j in range(len(cross)):
            pull = cross[j] - gram[j] @ weights + gram[j, j] * weights[j]
            weights[j] = np.sign(pull) * max(abs(pull) - alpha, 0.0) / gram[j, j]
        if np.max(np.abs(weights - before), initial=0.0) <= tolerance:
            break
    else:
        warnings.warn(f"the lasso has not converged after {rounds} rounds", stacklevel=3)
    return weights
