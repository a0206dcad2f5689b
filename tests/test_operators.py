"""Recodes, pivots, joins, imputation, lags, positions and checks on hand-written tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from regiotally.operators import checks, stats
from regiotally.operators.combine import append, attach, one_hot
from regiotally.operators.impute import fill_group_mean, fill_weighted_mean, whole_numbers
from regiotally.operators.panel import add_lags, add_season, complete_months, split_years
from regiotally.operators.position import fold_block, sliced, with_position
from regiotally.operators.recode import drop_unmapped, lookup_strict, recode_by_table, region_from_area
from regiotally.operators.reshape import (
    Split,
    arranged,
    by_listed_order,
    distinct_sorted,
    grouped_total,
    levels_of,
    pivot_count,
    pivot_single,
    pivot_total,
    totals_by_split,
    unique_keys,
)
from regiotally.operators.summary import by_magnitude, first_by, flag_extreme, top
from regiotally.plans.spec import INVOLVEMENT, POLICE_REGIONS, SUB_AREAS


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_region_recode_branches(spark):
    df = spark.createDataFrame(
        [
            ("Darwin", None),
            ("NT Balance", "Tanami"),
            ("NT Balance", "Nowhere"),
            ("NT Balance", None),
            ("Elsewhere", "Tanami"),
            (None, "Tanami"),
        ],
        "region string, area string",
    ).coalesce(1)
    place = region_from_area("region", "area", "NT Balance", SUB_AREAS, POLICE_REGIONS, "Top End")
    got = [r[0] for r in df.select(place).collect()]
    assert got == ["Greater Darwin", "Central Australia", "Top End", "Top End", "Elsewhere", None]


def test_strict_recode_fails_on_unknown_value(spark):
    good = spark.createDataFrame([("Yes",), ("No",), ("-",)], "f string").coalesce(1)
    assert [r[0] for r in good.select(lookup_strict("f", INVOLVEMENT)).collect()] == [1, 0, 0]
    for value in ("Maybe", None):
        bad = spark.createDataFrame([(value,)], "f string")
        with pytest.raises(PySparkException, match="recode table"):
            bad.select(lookup_strict("f", INVOLVEMENT)).collect()


def test_lenient_recode_drops_unknown_and_sums_merged_regions(spark):
    df = spark.createDataFrame(
        [(2024, "Darwin", 10.0), (2024, "Palmerston", 5.0), (2024, "Mars", 99.0), (2024, "Katherine", None)],
        "y int, region string, v double",
    )
    got = rows(grouped_total(drop_unmapped(df, "region", POLICE_REGIONS), ["y", "region"], ["v"]))
    assert got == [(2024, "Big Rivers", 0.0), (2024, "Greater Darwin", 15.0)]


def test_recode_by_table(spark):
    df = spark.createDataFrame([("a",), ("x",)], "k string")
    table = spark.createDataFrame([("a", "A")], "code string, name string")
    assert rows(recode_by_table(df, "k", table, "code", "name", "label")) == [("a", "A"), ("x", None)]


def test_null_keys_group_only_on_request(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k string, v int")
    assert rows(grouped_total(df, ["k"], ["v"])) == [("a", 4)]
    assert rows(grouped_total(df, ["k"], ["v"], keep_null_keys=True)) == [("a", 4), (None, 2)]


def test_totals_by_split_equals_joined_pivots(spark):
    pdf = pd.DataFrame(
        {
            "Year": [2024, 2024, 2024, 2025, 2025, 2025],
            "Region": ["A", "A", "B", "A", "B", "B"],
            "Sex": ["Male", "Female", "Male", "Female", "Male", None],
            "Age": ["0-4", "85+", "0-4", "0-4", "85+", "85+"],
            "Population": [10, 20, 30, 40, 50, 60],
        }
    )
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "Year int, Region string, Sex string, Age string, Population int")
    splits = [Split("Sex", ("Male", "Female")), Split("Age", ("0-4", "85+"), lambda v: f"age_{v}")]
    got = totals_by_split(df, ["Year", "Region"], "Population", "total", splits).toPandas()
    keys = ["Year", "Region"]
    want = pdf.groupby(keys)["Population"].sum().reset_index().rename(columns={"Population": "total"})
    for column in ("Sex", "Age"):
        wide = pdf.groupby([*keys, column])["Population"].sum().unstack(fill_value=0).reset_index()
        want = want.merge(wide, on=keys)
    want = want.rename(columns={"0-4": "age_0-4", "85+": "age_85+"})[got.columns]
    left, right = (f.sort_values(keys).reset_index(drop=True).astype(str) for f in (got, want))
    assert left.equals(right)


def test_key_with_only_null_levels_is_left_out(spark):
    df = spark.createDataFrame([("A", "m", 1), ("B", None, 2)], "region string, sex string, p int")
    assert rows(totals_by_split(df, ["region"], "p", "total", [Split("sex", ("m",))])) == [("A", 1, 1)]


def test_pivots(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("b", 2, 7)], "k string, y int, v int")
    assert rows(pivot_total(df, ["k"], "y", "v", (1, 2))) == [("a", 11, 0), ("b", 0, 7)]
    assert rows(pivot_count(df, ["k"], "y", (1, 2), "n")) == [("a", 2, 0), ("b", 0, 1)]
    single = df.filter("v > 5")
    assert rows(pivot_single(single, ["k"], "y", "v", (1, 2))) == [("a", 6, None), ("b", None, 7)]
    with pytest.raises(PySparkException, match="more than one row"):
        pivot_single(df, ["k"], "y", "v", (1, 2)).collect()
    assert pivot_total(df, ["k"], "y", "v").columns == ["k", "1", "2"]
    for build in (lambda: pivot_total(df, ["k"], "y", "v", (1,)), lambda: pivot_count(df, ["k"], "y", (1,)), lambda: pivot_single(single, ["k"], "y", "v", (1,))):
        with pytest.raises(PySparkException, match="not listed: 2"):
            build().collect()
    splits = [Split("y", ("1",)), Split("k", ())]
    text = df.withColumn("y", F.col("y").cast("string"))
    with pytest.raises(PySparkException, match="not listed: 2"):
        totals_by_split(text, ["v"], "v", "total", splits).collect()
    assert totals_by_split(text.filter("y = '1'"), ["v"], "v", "total", splits).columns == ["v", "total", "1", "a"]


def test_levels_and_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string")
    assert levels_of(df, "k") == ("a", "b")
    assert [r[0] for r in distinct_sorted(df, "k").collect()] == ["a", "b"]
    assert [r[0] for r in by_listed_order(df.distinct(), "k", ["b", "a"]).collect()] == ["b", "a"]
    with pytest.raises(PySparkException, match="k lacks z"):
        by_listed_order(df.distinct(), "k", ["a", "z"]).collect()
    wide = spark.createDataFrame([(1, 2, 3, 4)], "k int, p_b int, p_a int, last int")
    assert arranged(wide, ["k"], "p_", ["last"]).columns == ["k", "p_a", "p_b", "last"]


def test_append_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert rows(append([a, b])) == [(1, 2), (3, None)]


def test_attach_keeps_rows_and_null_keys(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    dimension = spark.createDataFrame([("a", 10)], "k string, d int")
    assert rows(attach(facts, unique_keys(dimension, ["k"]), ["k"])) == [("a", 1, 10), ("b", 2, None), (None, 3, None)]
    with pytest.raises(PySparkException, match="more than one row for a key of k"):
        attach(facts, unique_keys(dimension.union(dimension), ["k"]), ["k"]).collect()


def test_one_hot(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "r string").coalesce(1)
    got = [tuple(r) for r in one_hot(df, "r", ["A", "B"], "A", "r_").collect()]
    assert got == [("A", False), ("B", True), (None, False)]


def test_imputation_matches_row_weighted_mean(spark):
    rng = np.random.default_rng(3)
    cells = pd.DataFrame(
        [(y, q, r) for y in (2024, 2025) for q in (1, 2, 3, 4) for r in "AB"], columns=["y", "q", "r"]
    )
    cells["pac"] = rng.integers(100, 999, len(cells)).astype(float)
    cells.loc[(cells.y == 2025) & (cells.q >= 3), "pac"] = np.nan
    cells["n"] = rng.integers(1, 9, len(cells))
    pdf = cells.loc[cells.index.repeat(cells.n)].reset_index(drop=True)
    want = pdf.assign(pac=pdf.pac.fillna(pdf.groupby(["r", "q"])["pac"].transform("mean")))
    schema = "y int, q int, r string, pac double, n long"
    by_row = fill_group_mean(
        spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema), ["pac"], ["r", "q"]
    ).distinct().toPandas()
    by_cell = fill_weighted_mean(
        spark.createDataFrame(cells.astype(object).where(cells.notna(), None), schema), ["pac"], ["r", "q"], "n"
    ).toPandas()
    expected = want.drop_duplicates().set_index(["y", "q", "r"])["pac"].sort_index()
    for got in (by_row, by_cell):
        assert np.allclose(got.set_index(["y", "q", "r"])["pac"].sort_index(), expected)


def test_value_without_group_mean_fails(spark):
    df = spark.createDataFrame([("A", None), ("A", 2.5), ("B", 3.5)], "r string, v double")
    filled = fill_group_mean(df, ["v"], ["r"])
    assert rows(whole_numbers(filled, ["v"])) == [("A", 2), ("A", 2), ("B", 4)]
    empty = spark.createDataFrame([("A", None)], "r string, v double")
    with pytest.raises(PySparkException, match="impute"):
        whole_numbers(fill_group_mean(empty, ["v"], ["r"]), ["v"]).collect()


def test_lags_are_positional_unless_months_are_completed(spark):
    df = spark.createDataFrame([("A", 2024, 11, 1), ("A", 2024, 12, 2), ("A", 2025, 2, 4)], "r string, y int, m int, v int")
    lagged = add_lags(df, "r", ["y", "m"], "v", (1,), "lag")
    assert rows(lagged.select("y", "m", "lag1")) == [(2024, 11, None), (2024, 12, 1), (2025, 2, 2)]
    spine = add_lags(complete_months(df, "r", "y", "m"), "r", ["y", "m"], "v", (1,), "lag")
    assert rows(spine.select("y", "m", "v", "lag1")) == [
        (2024, 11, 1, None), (2024, 12, 2, 1), (2025, 1, None, 2), (2025, 2, 4, None),
    ]


def test_season_and_split(spark):
    df = spark.createDataFrame([(2024, 3), (2025, 6)], "y int, m int")
    got = {r["m"]: (r["sin_month"], r["cos_month"]) for r in add_season(df, "m").collect()}
    assert np.allclose(got[3], (1, 0)) and np.allclose(got[6], (0, -1))
    train, test = split_years(df, "y = 2024", "y = 2025")
    assert (train.count(), test.count()) == (1, 1)


def test_positions(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(5000)
    # A third of the rows share one value: the unique key spreads them over slices.
    data = [(int(min(v, 3300)), int(v)) for v in values]
    df = spark.createDataFrame(data, "v int, id int")
    placed, n = with_position(df, ["v", "id"])
    assert n == 5000 and {r["id"]: r["position"] for r in placed.collect()} == {i: i + 1 for i in range(5000)}
    few, n = with_position(df.filter("id < 3"), ["v", "id"], slices=50)
    assert n == 3 and sorted(r["position"] for r in few.collect()) == [1, 2, 3]
    named, _ = with_position(df.filter("id < 3"), ["v", "id"], "_place", slices=2)  # a name that is used inside
    assert named.columns == ["v", "id", "_place"] and sorted(r["_place"] for r in named.collect()) == [1, 2, 3]
    none, n = with_position(df.filter("id < 0"), ["v", "id"])
    assert n == 0 and none.count() == 0
    nulls, n = with_position(spark.createDataFrame([(None, 1), (5, 2), (None, 3)], "v int, id int"), ["v", "id"])
    assert sorted((r["position"], r["id"]) for r in nulls.collect()) == [(1, 1), (2, 3), (3, 2)]


def test_slices_spread_a_hot_value(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"), "id")
    counts = [r["count"] for r in sliced(df, ["v", "id"], 8).groupBy("_slice").count().collect()]
    assert len(counts) == 8 and max(counts) < 40_000 / 4


def test_fold_blocks(spark):
    for n in (126, 130, 11):
        size = n // 6
        df = spark.range(1, n + 1).withColumn("b", fold_block("id", n, 5))
        got = [r["b"] for r in df.orderBy("id").collect()]
        want = [0] * (n - 5 * size) + [k for k in range(1, 6) for _ in range(size)]
        assert got == want
    with pytest.raises(ValueError, match="too few"):
        fold_block("id", 4, 5)


def test_summary_picks(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, -9)], "k int, v int")
    assert rows(flag_extreme(df, "v", "peak")) == [(1, 5, False), (2, 9, True), (3, 9, True), (4, -9, False)]
    assert first_by(df, F.col("v").desc(), "k").first()["k"] == 2
    assert [r["k"] for r in top(df, 2, "v", "k").collect()] == [4, 1]
    assert [r["k"] for r in by_magnitude(df, "v", "k").collect()] == [2, 3, 4, 1]


def test_profile_checks(spark):
    df = spark.createDataFrame([(1, None, "a b"), (2, None, None)], "k int, `Total PAC` int, s string")
    assert rows(checks.null_counts(df)) == [("Total PAC", 2), ("s", 1)]
    assert rows(checks.coverage(df, ["k"])) == [(1, 1), (2, 1)]


def test_skewness_and_correlation(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.gamma(2, size=200), "b": rng.normal(size=200), "c": 1.0})
    pdf.loc[5, "b"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    row = df.agg(stats.skew_adjusted("a").alias("a"), stats.pearson("a", "b").alias("r"), stats.pearson("a", "c").alias("n")).first()
    assert row["a"] == pytest.approx(pdf.a.skew(), rel=1e-12)
    assert row["r"] == pytest.approx(pdf.a.corr(pdf.b), rel=1e-12)
    assert row["n"] is None
    matrix = {(r[0], r[1]): r[2] for r in stats.correlation_matrix(df, ["a", "b"], {"a": "A"}).collect()}
    assert matrix["A", "b"] == matrix["b", "A"] == pytest.approx(pdf.a.corr(pdf.b), rel=1e-12)
    assert matrix["A", "A"] == pytest.approx(1)


@pytest.mark.parametrize("values", [np.arange(61.0), np.random.default_rng(2).gamma(2, size=500), np.full(7, 4.0)])
def test_histogram(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = stats.histogram(df, "x").orderBy("bin").toPandas()
    counts, edges = np.histogram(values, bins=30)
    assert list(got["n"]) == list(counts)
    assert np.allclose(got["from_value"], edges[:-1]) and np.allclose(got["to_value"], edges[1:])


def test_histogram_edges(spark):
    """Whole numbers that fall on bin edges, and their logs: two hundred samples, counted in one pass each."""
    for seed in range(200):
        pick = np.random.default_rng(seed)
        whole = pick.integers(0, int(pick.integers(20, 2000)), size=int(pick.integers(50, 400)))
        values = np.log1p(whole) if seed % 2 else whole.astype(float)
        low, high = values.min(), values.max()
        if seed < 12:
            got = stats.histogram(spark.createDataFrame(pd.DataFrame({"x": values})), "x").orderBy("bin").toPandas()["n"]
            assert list(got) == list(np.histogram(values, bins=30)[0]), seed
        width = (high - low) / 30  # the same steps as in the expression
        guess = np.clip(np.floor((values - low) / width), 0, 29).astype(int)
        edge = lambda k: np.where(k == 30, high, low + k * width)
        place = np.where(values < edge(guess), guess - 1, np.where((values >= edge(guess + 1)) & (guess < 29), guess + 1, guess))
        assert list(np.bincount(place, minlength=30)) == list(np.histogram(values, bins=30)[0]), seed


def test_density_and_trend(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.gamma(3, size=300), 1)
    y = 2 * x + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = stats.density(df, "x").orderBy("point").toPandas()
    grid = np.linspace(x.min(), x.max(), 200)
    h = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], grid) and np.allclose(got["density"], want, rtol=1e-9)
    curve = stats.density(df, "x", bins=30).orderBy("point").toPandas()["curve"]
    assert np.allclose(curve, want * len(x) * (x.max() - x.min()) / 30)
    flat = stats.density(df.withColumn("x", F.lit(3.0)), "x", points=5).collect()
    assert [r["density"] for r in flat] == [None] * 5
    line = stats.trend_line(df, "x", "y").orderBy("point").toPandas()
    slope, intercept = np.polyfit(x, y, 1)
    at = np.linspace(x.min(), x.max(), 100)
    assert np.allclose(line["x"], at) and np.allclose(line["y"], intercept + slope * at)
