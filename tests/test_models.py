"""Scaling, regressions, validation and diagnostics against closed forms in numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regiotally.operators.diagnostics import (
    inflation_factors,
    inflation_from_sums,
    paired_t,
    paired_t_test,
    quantile_line,
    quantile_plot,
    shapiro_wilk,
)
from regiotally.functions.pvalues import student_p
from regiotally.operators.linear import LASSO, OLS, RIDGE, Moments, fit_moments, fit_rows, fit_subset, moments_by
from regiotally.operators.scaling import fit_scaler, standardize
from regiotally.operators.validation import fold_blocks, fold_errors, mean_error, placed_moments

FEATURES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 132
    frame = pd.DataFrame({"a": rng.normal(5, 2, n), "b": rng.gamma(2, 3, n)})
    frame["c"] = 0.8 * frame.a + rng.normal(0, 1, n)
    frame["flat"] = 3.0
    frame["y"] = 7 + 0.3 * frame.a - 0.1 * frame.b + rng.normal(0, 0.2, n)
    frame["id"] = np.arange(n)
    frame["part"] = frame.id < 90
    return frame


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data)


def standardised(x):
    spread = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(spread == 0, 1, spread)


def least_squares(x, y, alpha=0.0):
    """Normal equations with an unpenalised intercept; the smallest solution if they are singular."""
    centre, level = x.mean(axis=0), y.mean()
    gram = (x - centre).T @ (x - centre) + alpha * np.eye(x.shape[1])
    weights = np.linalg.pinv(gram, rcond=1e-12) @ (x - centre).T @ (y - level)
    return weights, level - weights @ centre


def lasso_gap(x, y, weights, alpha):
    """Largest violation of the optimality conditions of the lasso."""
    centred, rest = x - x.mean(axis=0), y - y.mean() - (x - x.mean(axis=0)) @ weights
    slope = centred.T @ rest / len(y)
    return max(
        abs(slope[j] - alpha * np.sign(weights[j])) if weights[j] else max(abs(slope[j]) - alpha, 0.0)
        for j in range(len(weights))
    )


def test_scaler_uses_population_deviation(df, data):
    want = standardised(data[FEATURES].to_numpy())
    scaled = fit_scaler(df, FEATURES).apply(df, FEATURES).orderBy("id").toPandas()
    lazy = standardize(df, FEATURES).orderBy("id").toPandas()
    for got in (scaled, lazy):
        assert np.allclose(got[[f"z_{f}" for f in FEATURES]].to_numpy(), want)


def test_scaler_of_a_part_comes_out_of_the_moments(df):
    whole, part = fit_scaler(df, FEATURES), fit_scaler(df.filter("part"), FEATURES)
    moments = moments_by(whole.apply(df, FEATURES), FEATURES, "y", ["part"])[(True,)]
    scaler, scaled = whole.refined(moments, FEATURES)
    assert scaler.rows == part.rows == 90
    for f in FEATURES:
        assert scaler.centre[f] == pytest.approx(part.centre[f]) and scaler.spread[f] == pytest.approx(part.spread[f])
    assert np.allclose(scaled.x, 0, atol=1e-9) and np.allclose(np.diag(scaled.xx)[:3], 90)


def test_feature_that_is_constant_in_the_training_part(df, data):
    """Its weight is 0 and its spread 1, although it varies over all rows."""
    late = df.withColumn("late", F.when(F.col("part"), 3.7).otherwise(F.col("a")))
    names = ["a", "late"]
    whole = fit_scaler(late, names)
    moments = moments_by(whole.apply(late, names), names, "y", ["part"])[(True,)]
    scaler, scaled = whole.refined(moments, names)
    assert scaler.centre["late"] == pytest.approx(3.7) and scaler.spread["late"] == whole.spread["late"]
    for kind, alpha in [(OLS, 0.0), (RIDGE, 1.0), (LASSO, 0.01)]:
        assert abs(fit_subset(scaled, names, names, kind, alpha).coefficients[1]) < 1e-9
    train = data[data.part]
    slope = np.polyfit(train.a, train.y, 1)[0] * train.a.std(ddof=0)
    assert fit_subset(scaled, names, names, OLS).coefficients[0] == pytest.approx(slope)


@pytest.mark.parametrize("kind,alpha", [(OLS, 0.0), (RIDGE, 0.01), (RIDGE, 10.0), (RIDGE, 100.0), (LASSO, 0.01), (LASSO, 0.1), (LASSO, 1.0)])
def test_fits_on_rows_and_on_moments_agree_with_numpy(df, data, kind, alpha):
    scaler = fit_scaler(df, FEATURES)
    scaled = scaler.apply(df, FEATURES).withColumn("g", F.lit(0))
    moments = moments_by(scaled, FEATURES, "y", ["g"])[(0,)]
    by_rows = fit_rows(scaled, FEATURES, "y", [(kind, alpha)], moments)[0]
    by_sums = fit_subset(moments, FEATURES, FEATURES, kind, alpha)
    x, y = standardised(data[FEATURES].to_numpy()), data["y"].to_numpy()
    for fit in (by_rows, by_sums):
        if kind == LASSO:
            assert lasso_gap(x, y, np.array(fit.coefficients), alpha) < 1e-7
        else:
            weights, intercept = least_squares(x, y, alpha)
            assert np.allclose(fit.coefficients, weights, atol=1e-8)
            assert fit.intercept == pytest.approx(intercept)
    assert np.allclose(by_rows.coefficients, by_sums.coefficients, atol=1e-6)
    predicted = [r[0] for r in scaled.orderBy("id").select(by_rows.column()).collect()]
    assert np.allclose(predicted, x @ np.array(by_rows.coefficients) + by_rows.intercept)


def test_null_target_is_an_error(df):
    gaps = df.withColumn("y", F.when(F.col("id") > 3, F.col("y")))
    scaled = fit_scaler(gaps, FEATURES).apply(gaps, FEATURES)
    with pytest.raises(ValueError, match="4 rows"):
        moments_by(scaled.withColumn("g", F.lit(0)), FEATURES, "y", ["g"])


def expanding_folds(n, folds=5):
    size = n // (folds + 1)
    return [(n - (folds + 1 - k) * size, n - (folds - k) * size) for k in range(1, folds + 1)]


@pytest.mark.parametrize("scale", ["global", "per_fold"])
@pytest.mark.parametrize("kind,alpha", [(OLS, 0.0), (RIDGE, 1.0), (RIDGE, 100.0)])
def test_expanding_validation(df, data, scale, kind, alpha):
    scaler = fit_scaler(df.filter("part"), FEATURES)
    moments = placed_moments(df, FEATURES, "y", ["id"], scaler, "part")
    got = fold_errors(fold_blocks(moments, range(len(FEATURES))), kind, alpha, scale)
    raw, y = data[FEATURES].to_numpy(), data["y"].to_numpy()
    want = []
    for start, stop in expanding_folds(len(data)):
        x = standardised(raw)
        if scale == "per_fold":
            spread = raw[:start].std(axis=0)
            x = (raw - raw[:start].mean(axis=0)) / np.where(spread == 0, 1, spread)
        weights, intercept = least_squares(x[:start], y[:start], alpha)
        want.append(np.sqrt(np.mean((y[start:stop] - x[start:stop] @ weights - intercept) ** 2)))
    assert np.allclose(got, want, rtol=1e-7)


def test_lasso_validation_meets_optimality(df, data):
    scaler = fit_scaler(df, FEATURES)
    blocks = fold_blocks(placed_moments(df, FEATURES, "y", ["id"], scaler, "part"), [0, 1, 2])
    x, y = standardised(data[FEATURES[:3]].to_numpy()), data["y"].to_numpy()
    errors = []
    for k, (start, stop) in enumerate(expanding_folds(len(data)), 1):
        train = blocks[0]
        for i in range(1, k):
            train = train + blocks[i]
        weights, intercept = fit_moments(train, LASSO, 0.05)
        assert lasso_gap(x[:start], y[:start], weights, 0.05) < 1e-9
        errors.append(np.sqrt(np.mean((y[start:stop] - x[start:stop] @ weights - intercept) ** 2)))
    assert mean_error(blocks, LASSO, 0.05) == pytest.approx(np.mean(errors))


def vif_by_regression(x, i, constant=False):
    others = np.delete(x, i, axis=1)
    fitted = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
    total = x[:, i] - (x[:, i].mean() if constant else 0)
    return (total @ total) / ((x[:, i] - fitted) @ (x[:, i] - fitted))


def test_inflation_without_intercept(df, data):
    got = {r["feature"]: r["vif"] for r in inflation_factors(df, ["a", "b", "c"]).collect()}
    x = data[["a", "b", "c"]].to_numpy()
    for i, name in enumerate("abc"):
        assert got[name] == pytest.approx(vif_by_regression(x, i))


def test_inflation_with_constant_and_with_collinear_columns(df, data):
    got = {r["feature"]: r["vif"] for r in inflation_factors(df, ["a", "b", "flat"]).collect()}
    x = data[["a", "b", "flat"]].to_numpy()
    assert got["a"] == pytest.approx(vif_by_regression(x, 0, constant=True))
    assert got["flat"] == pytest.approx(vif_by_regression(x, 2))
    doubled = df.withColumn("twice", F.col("a") * 2)
    table = {r["feature"]: (r["vif"], r["assessment"]) for r in inflation_factors(doubled, ["a", "b", "twice"]).collect()}
    assert table["a"] == (math.inf, "High") and table["twice"][0] == math.inf and table["b"][0] < 50
    assert inflation_from_sums(np.diag([2.0, 3.0]), np.zeros(2), 5.0) == [1.0, 1.0]


def test_quantile_table(spark, df, data):
    plot = quantile_plot(df, "y", ["id"]).orderBy("position").toPandas()
    n = len(data)
    level = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    level[0], level[-1] = 1 - 0.5 ** (1 / n), 0.5 ** (1 / n)
    assert np.allclose(plot["level"], level) and np.allclose(plot["ordered"], np.sort(data["y"]))
    line = quantile_line(quantile_plot(df, "y", ["id"])).first()
    slope, intercept = np.polyfit(plot["theoretical"], plot["ordered"], 1)
    assert (line["slope"], line["intercept"]) == pytest.approx((slope, intercept))
    holes = df.select(F.when(F.col("id") > 3, F.col("y")).alias("y"), "id")
    assert quantile_plot(holes, "y", ["id"]).count() == df.filter("id > 3").count()


def test_shapiro_wilk_on_published_weights(spark):
    # Weights of eleven men (Shapiro and Wilk, 1965): W = 0.79 in the paper, 0.7888 and p = 0.0067 by Royston.
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    sample = spark.createDataFrame([(float(v), i) for i, v in enumerate(men)], "v double, i int")
    row = shapiro_wilk(sample, "v", ["i"]).first()
    assert row["w"] == pytest.approx(0.78881, abs=1e-4)
    assert row["p_value"] == pytest.approx(0.0067, abs=1e-4)
    assert row["normality"] == "rejected"
    three = spark.createDataFrame([(1.0, 1), (2.0, 2), (4.0, 3)], "v double, i int")
    assert shapiro_wilk(three, "v", ["i"]).first()["w"] == pytest.approx(27 / 28, abs=1e-6)
    five = spark.createDataFrame([(v, int(v * 10)) for v in (1.0, 2.0, 3.5, 4.0, 9.0)], "v double, i int")
    assert 0.7 < shapiro_wilk(five, "v", ["i"]).first()["w"] < 1


def test_shapiro_wilk_accepts_normal_rows_in_slices(spark):
    rng = np.random.default_rng(11)
    sample = spark.createDataFrame([(float(v), i) for i, v in enumerate(rng.normal(size=800))], "v double, i int")
    row = shapiro_wilk(sample, "v", ["i"]).first()
    assert row["w"] > 0.99 and row["p_value"] > 0.05
    more = sample.unionByName(spark.createDataFrame([(None, 1000), (None, 1001)], "v double, i int"))
    assert shapiro_wilk(more, "v", ["i"]).first() == row
    alike = spark.createDataFrame([(2.5, i) for i in range(9)], "v double, i int")
    assert tuple(shapiro_wilk(alike, "v", ["i"]).first())[1:3] == (1.0, 1.0)


def test_student_p_of_many_rows():
    for t in (0.5, 1.96, 3.0):
        normal = math.erfc(t / math.sqrt(2))
        assert student_p(t, 5_000_000) == pytest.approx(normal, rel=1e-5)
        assert student_p(t, 2_000_000_000) == pytest.approx(normal, rel=1e-5)
    assert student_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)


def test_paired_t(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(60, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in e], "p double, q double, r double")
    errors = {"P": "p", "Q": "q", "R": "r"}
    got = {(r["model_a"], r["model_b"]): r for r in paired_t_test(df, errors).collect()}
    assert list(got) == [("P", "Q"), ("P", "R"), ("Q", "R")]
    for (a, b), (i, j) in zip(got, [(0, 1), (0, 2), (1, 2)]):
        gap = np.abs(e[:, i]) - np.abs(e[:, j])
        t = gap.mean() / (gap.std(ddof=1) / np.sqrt(60))
        assert got[a, b]["t_stat"] == pytest.approx(t) and got[a, b]["n"] == 60
        assert got[a, b]["significant"] == (abs(t) > 2.001)
    same = paired_t(df, {"P": "p", "Again": "p"}).first()
    assert same["t_stat"] is None


def test_moments_of_affine_features():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    m = Moments(20, x.sum(axis=0), x.T @ x, y.sum(), x.T @ y, y @ y)
    centre, spread = np.array([1.0, 2.0, 3.0]), np.array([0.5, 2.0, 4.0])
    z = (x - centre) / spread
    got = m.scaled(centre, spread)
    assert np.allclose(got.x, z.sum(axis=0)) and np.allclose(got.xx, z.T @ z) and np.allclose(got.xy, z.T @ y)
