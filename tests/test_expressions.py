"""Null, rounding, calendar and label rules on single columns."""

import datetime
import statistics

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regiotally.functions.calendar import (
    MONTH_LABELS,
    month_label,
    period_label,
    quarter_of_month,
    quarter_of_quarter_end,
)
from regiotally.functions.labels import age_column, before_colon, fixed, thousands, without_code
from regiotally.functions.normal import inverse_normal
from regiotally.functions.nulls import differs_or_null, total
from regiotally.functions.numeric import band_label, mean_of_rounded, rate_per, round_even, share_pct
from regiotally.functions.pvalues import shapiro_p, student_p


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_not_equal_keeps_null_rows(spark):
    df = spark.createDataFrame([("Unknown",), ("Darwin",), (None,)], "region string")
    assert {r[0] for r in df.filter(differs_or_null("region", "Unknown")).collect()} == {"Darwin", None}


def test_sum_of_nulls_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3)], "k int, v int")
    assert {r[0]: r[1] for r in df.groupBy("k").agg(total("v")).collect()} == {1: 0, 2: 3}


def test_rounding_is_half_even_on_the_double(spark):
    values = [1.015, 2.675, 0.125, 0.375, 2.5, 3.5, -2.5, 1234.5, 0.05, 1.45]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    for digits in (0, 1, 2):
        assert column(df, round_even("x", digits)) == list(np.round(np.array(values), digits))


def test_mean_of_rounded_sees_a_tie(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.2,), (0.1,)], "x double")
    mean = df.agg(mean_of_rounded("x", 1).alias("m")).first()["m"]
    assert mean == 0.15


def test_rates_do_not_divide_by_zero(spark):
    df = spark.createDataFrame([(5, 1000), (5, 0), (5, None)], "n int, pop int").coalesce(1)
    assert column(df, rate_per("n", "pop")) == [500.0, None, None]
    assert column(df, share_pct("n", "pop")) == [0.5, None, None]


def test_bands(spark):
    df = spark.createDataFrame([(60.0,), (50.0,), (10.5,), (10.0,)], "v double").coalesce(1)
    bands = [(50.0, "High"), (10.0, "Elevated")]
    assert column(df, band_label("v", bands, "Acceptable")) == ["High", "Elevated", "Elevated", "Acceptable"]


def test_calendar(spark):
    df = spark.range(1, 13).withColumnRenamed("id", "m").coalesce(1)
    assert column(df, quarter_of_month("m")) == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]
    assert column(df, month_label("m")) == MONTH_LABELS
    one = spark.createDataFrame([(2024, 1)], "y int, q int")
    assert column(one, period_label("y", "q")) == ["2024-Q1"]


def test_quarter_end_months_are_checked(spark):
    good = spark.createDataFrame([(datetime.date(2024, m, 28),) for m in (3, 6, 9, 12)], "d date").coalesce(1)
    assert column(good, quarter_of_quarter_end("d")) == [1, 2, 3, 4]
    bad = spark.createDataFrame([(datetime.date(2024, 5, 31),)], "d date")
    with pytest.raises(PySparkException, match="quarter-end"):
        column(bad, quarter_of_quarter_end("d"))


def test_labels(spark):
    df = spark.createDataFrame([("02 Assault",), ("07 Theft and fraud",)], "c string").coalesce(1)
    assert column(df, without_code("c")) == ["Assault", "Theft and fraud"]
    assert column(df, before_colon(F.lit("V1: Temporal only")))[0] == "V1"
    assert age_column("10-14") == "Pop_age_1014" and age_column("85+") == "Pop_age_85plus"
    one = spark.range(1)
    assert column(one, thousands(F.lit(1234567))) == ["1,234,567"]
    assert column(one, fixed(F.lit(2.25), 1)) == ["2.3"]


def test_inverse_normal(spark):
    levels = [1e-12, 1e-6, 0.01, 0.05, 0.074, 0.2, 0.5, 0.7, 0.93, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in levels], "p double").coalesce(1)
    want = [statistics.NormalDist().inv_cdf(p) for p in levels]
    assert np.allclose(column(df, inverse_normal(F.col("p"))), want, rtol=1e-13, atol=1e-15)
    edges = spark.createDataFrame([(0.0,), (1.0,)], "p double")
    assert column(edges, inverse_normal(F.col("p"))) == [None, None]


def test_student_p_against_published_quantiles():
    # Two-sided 5 % and 1 % points of Student's t.
    for df, five, one in [(1, 12.706, 63.657), (5, 2.571, 4.032), (30, 2.042, 2.750), (120, 1.980, 2.617)]:
        assert student_p(five, df) == pytest.approx(0.05, abs=2e-4)
        assert student_p(-one, df) == pytest.approx(0.01, abs=1e-4)
    assert student_p(0.0, 7) == pytest.approx(1.0)
    assert student_p(1.959964, 10_000_000) == pytest.approx(0.05, abs=1e-6)
    assert student_p(1.959966, 999_999) == pytest.approx(0.05, abs=1e-6)


def test_shapiro_p_against_published_quantiles():
    # Five per cent points of W for n = 10 and 20 (Shapiro and Wilk, 1965).
    for n, five in [(10, 0.842), (20, 0.905)]:
        assert shapiro_p(five, n) == pytest.approx(0.05, abs=0.006)
    assert shapiro_p(1.0, 20) == 1.0
