"""Ordered first, normality of many rows, wide correlation, encoders, two-key recodes, null-safe joins and observed counts."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from regiotally.functions.normal import normal_below
from regiotally.functions.nulls import first_known
from regiotally.functions.pvalues import kolmogorov_p
from regiotally.operators import stats
from regiotally.operators.combine import attach_null_safe, one_hot
from regiotally.operators.diagnostics import kolmogorov_smirnov
from regiotally.operators.encode import fit_encoder
from regiotally.operators.impute import fill_group_mean, fill_weighted_mean
from regiotally.operators.recode import recode_pairs, region_from_area, unmapped
from regiotally.operators.reshape import levels_of
from regiotally.sources.delimited import read_with_rejects
from regiotally.sources.yearly import read_yearly


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# First known value -----------------------------------------------------------------------------------


def test_first_known_by_order(spark):
    data = [("a", None, 1, 1), ("a", "x", 2, 2), ("a", "y", 3, 3), ("b", None, 1, 4), ("c", "q", 5, 5), ("c", "p", 5, 6), ("d", "late", 2, 7), ("d", "none", None, 8)]
    df = spark.createDataFrame(data, "k string, v string, o int, id int")
    got = dict(rows(df.groupBy("k").agg(first_known("v", "o"))))
    assert got == {"a": "x", "b": None, "c": "p", "d": "none"}  # ties take the smaller value, an unknown place comes first
    assert dict(rows(df.groupBy("k").agg(first_known("v", "o", "id"))))["c"] == "q"
    assert dict(rows(df.groupBy("k").agg(first_known("v", F.col("o").desc_nulls_last() if False else -F.col("o")))))["a"] == "y"


# Normality -------------------------------------------------------------------------------------------


def test_normal_below(spark):
    points = [-40.0, -20.0, -8.0, -7.2, -7.0, -3.1, -1.0, -1e-9, 0.0, 0.4, 2.0, 6.9, 7.3, 38.0]
    df = spark.createDataFrame([(p,) for p in points], "x double")
    for x, got in df.select("x", normal_below("x")).collect():
        want = math.erfc(-x / math.sqrt(2)) / 2
        assert got == pytest.approx(want, rel=2e-11, abs=1e-15)


def test_kolmogorov_p():
    for x in (0.2, 0.5, 0.9, 1.0, 1.3, 2.0, 3.0):  # both series, summed plainly
        n = 10_000
        distance = x / (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
        alternating = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 400))
        assert kolmogorov_p(distance, n) == pytest.approx(alternating, abs=1e-12)
    assert kolmogorov_p(0.0, 5) == 1.0 and kolmogorov_p(1.0, 1_000_000) == 0.0


@pytest.mark.parametrize("kind", ["normal", "uniform", "tied"])
def test_kolmogorov_smirnov_against_a_plain_scan(spark, kind):
    pick = np.random.default_rng(8)
    values = {"normal": pick.normal(3, 2, 4000), "uniform": pick.uniform(size=4000), "tied": pick.integers(0, 9, 4000).astype(float)}[kind]
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)] + [(None, -1)], "v double, id int")
    row = kolmogorov_smirnov(df, "v", ["id"]).first()
    fitted = NormalDist(values.mean(), values.std(ddof=1))
    below = np.array([fitted.cdf(v) for v in np.sort(values)])
    steps = np.arange(1, len(values) + 1) / len(values)
    want = max((steps - below).max(), (below - steps + 1 / len(values)).max())
    assert row["n"] == 4000 and row["distance"] == pytest.approx(want, abs=1e-12)
    assert (row["normality"] == "not rejected") == (kind == "normal")


def test_kolmogorov_smirnov_without_a_test(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 2)], "v double, id int")
    assert tuple(kolmogorov_smirnov(df, "v", ["id"]).first()) == (2, None, None, None)
    assert tuple(kolmogorov_smirnov(df.limit(0), "v", ["id"]).first()) == (0, None, None, None)
    assert kolmogorov_smirnov(df, "v", ["id"], 0.0, 1.0).first()["distance"] == pytest.approx(NormalDist().cdf(1.0))


# Wide correlation and density ------------------------------------------------------------------------


def test_wide_correlation_equals_the_narrow_one(spark):
    pick = np.random.default_rng(5)
    data = 1e6 + pick.normal(size=(400, 6)) @ pick.normal(size=(6, 6))
    data[:, 5] = 4.0
    cells = [[None if pick.random() < 0.1 else float(v) for v in row] for row in data]
    df = spark.createDataFrame(cells, ", ".join(f"c{i} double" for i in range(6)))
    names = df.columns
    narrow = {(r[0], r[1]): r[2] for r in stats.correlation_matrix(df, names).collect()}
    wide = {(r[0], r[1]): r[2] for r in stats.correlation_wide(df, names, {}).collect()}
    assert wide.keys() == narrow.keys()
    for pair, r in narrow.items():
        assert (wide[pair] is None and r is None) or wide[pair] == pytest.approx(r, abs=1e-8), pair
    assert all(r[2] is None for r in stats.correlation_wide(df.limit(0), names).collect())


def test_three_hundred_columns(spark):
    pick = np.random.default_rng(6)
    data = pick.normal(size=(50, 300))
    df = spark.createDataFrame([[v] for v in data.tolist()], "v array<double>").select(*[F.col("v")[i].alias(f"c{i}") for i in range(300)])
    got = stats.correlation_wide(df, df.columns)
    table = {(r[0], r[1]): r[2] for r in got.collect()}
    want = np.corrcoef(data.T)
    assert all(table[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], abs=1e-9) for i in range(0, 300, 37) for j in range(0, 300, 23))


def test_density_of_skewed_values_and_outliers(spark):
    pick = np.random.default_rng(7)
    values = np.concatenate([pick.lognormal(2, 1.5, 3000), [1e5]])
    got = stats.density(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").orderBy("point").toPandas()
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - values[None, :]) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
    assert np.allclose(got["density"], want, rtol=0, atol=1e-12 / h)


# Encoders and recodes --------------------------------------------------------------------------------


def test_levels_are_fitted_and_unseen_ones_told(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "r string")
    later = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "r string")
    encoder = fit_encoder(train, "r", "r_")
    assert encoder.levels == ("a", "b") and encoder.reference == "a" and encoder.names == ["r_b"]
    assert rows(encoder.apply(later, unknown="r_new")) == sorted([("a", False, False), ("b", True, False), ("z", False, True), (None, False, False)], key=str)
    with pytest.raises(PySparkException, match="not listed: z"):
        encoder.apply(later).collect()
    assert rows(encoder.apply(train)) == sorted([("a", False), ("b", True), ("b", True), (None, False)], key=str)
    with pytest.raises(ValueError, match="no level q"):
        fit_encoder(train, "r", "r_", reference="q")
    with pytest.raises(ValueError, match="more than 1 levels"):
        fit_encoder(train, "r", "r_", most=1)
    none = fit_encoder(train.limit(0), "r", "r_")
    assert none.names == [] and rows(none.apply(later, "new").select("new")) == [(False,), (True,), (True,), (True,)]


def test_an_undeclared_level_is_not_the_reference(spark):
    df = spark.createDataFrame([("A",), ("C",)], "r string")
    with pytest.raises(PySparkException, match="not listed: C"):
        one_hot(df, "r", ["A", "B"], "A", "r_").collect()
    with pytest.raises(ValueError, match="more than 3 levels"):
        levels_of(spark.range(5), "id", 3)


def test_two_key_recode(spark):
    places = [("N", "a"), ("N", "b"), ("N", None), ("M", "a"), ("X", "a"), (None, "a"), (None, None)]
    df = spark.createDataFrame(places, "region string, area string")
    table = spark.createDataFrame([("N", "a", "east"), ("N", None, "rest"), ("M", None, None), (None, "a", "no")], "first string, second string, value string")
    got = recode_pairs(df, "region", "area", table, "place")
    want = [("N", "a", "east", "pair"), ("N", "b", "rest", "first"), ("N", None, "rest", "first"), ("M", "a", None, "first"), ("X", "a", "X", "none"), (None, "a", None, "none"), (None, None, None, "none")]
    assert rows(got) == sorted(want, key=str)
    assert rows(unmapped(got, "region", "area")) == sorted([("X", "a", 1), (None, "a", 1), (None, None, 1)], key=str)
    with pytest.raises(PySparkException, match="more than one row for a key"):
        recode_pairs(df, "region", "area", table.union(table), "place").collect()


def test_large_recode_table_equals_literals(spark):
    areas = {f"area{i}": f"place{i % 9}" for i in range(0, 20_000)}
    table = spark.createDataFrame([("N", a, p) for a, p in areas.items()] + [("N", None, "rest"), ("S", None, "south")], "first string, second string, value string")
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "S").when(F.col("id") % 3 == 1, "N").otherwise("T").alias("r"), F.concat(F.lit("area"), F.col("id")).alias("a"))
    small = {a: p for a, p in areas.items() if int(a[4:]) < 200}
    wanted = df.filter("cast(substring(a, 5) as int) < 200").select("r", "a", region_from_area("r", "a", "N", small, {"S": "south"}, "rest").alias("p"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = recode_pairs(df, "r", "a", table, "p")
        assert rows(got.filter("cast(substring(a, 5) as int) < 200").drop("match")) == rows(wanted)
        assert {r[0]: r[1] for r in got.groupBy("match").count().collect()} == {"first": 10_000 + 3_333, "pair": 6_667, "none": 10_000}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_keys_meet_and_means_skip_them(spark):
    facts = spark.createDataFrame([("a", 1, 1.0), ("a", 1, None), (None, 1, 4.0), (None, 1, None), ("b", None, None)], "k string, q int, v double")
    dimension = spark.createDataFrame([("a", 10), (None, 20)], "k string, d int")
    assert sorted(r["d"] or 0 for r in attach_null_safe(facts, dimension, ["k"]).collect()) == [0, 10, 10, 20, 20]
    filled = fill_group_mean(facts, ["v"], ["k", "q"])
    assert rows(filled) == sorted([("a", 1, 1.0), ("a", 1, 1.0), (None, 1, 4.0), (None, 1, None), ("b", None, None)], key=str)
    weighted = fill_weighted_mean(facts.withColumn("n", F.lit(2)), ["v"], ["k", "q"], "n").drop("n")
    assert rows(weighted) == rows(filled)


# Files -----------------------------------------------------------------------------------------------

KINDS = StructType([StructField("name", StringType()), StructField("n", LongType()), StructField("x", DoubleType())])


def test_rejects_beside_clean_rows(spark, tmp_path):
    lines = ["name, n ,x,more", "a,1,1.5,p", "b,two,2.5,q", "c,3,oops,", "d,4,1.0", "e,5,2.0,r,s", ",6,NA,t", "NA,seven,x,u", '"f,g",7,NaN,', "NA,8,3.5,"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    clean, rejects = read_with_rejects(spark, str(tmp_path / "in.csv"), KINDS, required=["name"])
    assert rows(clean) == sorted([("a", 1, 1.5), ("f,g", 7, None)], key=str)
    got = {r["line"]: r["reason"] for r in rejects.collect()}
    assert got["b,two,2.5,q"] == "type of n" and got["d,4,1.0"] == got["e,5,2.0,r,s"] == "number of values"
    assert sorted(got.values()) == ["missing name", "missing name", "number of values", "number of values", "type of n", "type of n", "type of x"]
    assert all(r["file"].endswith("in.csv") for r in rejects.collect())
    assert clean.count() + rejects.count() == len(lines) - 1


def test_yearly_files_and_folders(spark, tmp_path):
    folder = tmp_path / "of 2019+x"  # a year and odd signs above the files
    folder.mkdir()
    for year in (2023, 2024):
        (folder / f"supply-{year}.csv").write_text(f"name,n,x\n{year % 100},1,0.5\n")
    got = read_yearly(spark, f"{folder}/supply-*.csv", KINDS)
    assert rows(got) == [("23", 1, 0.5, 2023), ("24", 1, 0.5, 2024)]
    for year in (2023, 2024):
        spark.createDataFrame([("p", year, 1.0, 9)], "name string, n long, x double, extra int").write.parquet(str(folder / f"part-{year}"))
    assert rows(read_yearly(spark, f"{folder}/part-*", KINDS, "y", "parquet")) == [("p", 2023, 1.0, 2023), ("p", 2024, 1.0, 2024)]


def test_yearly_files_that_do_not_fit_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing matches"):
        read_yearly(spark, f"{tmp_path}/none-*", KINDS)
    spark.createDataFrame([("p", 1)], "name string, n int").write.parquet(str(tmp_path / "t-2024"))
    with pytest.raises(ValueError, match="t-2024 has n as int, not bigint"):
        read_yearly(spark, f"{tmp_path}/t-*", KINDS, kind="parquet")
    spark.createDataFrame([("p", 1)], "name string, n long").write.parquet(str(tmp_path / "u-2024"))
    with pytest.raises(ValueError, match="u-2024 has no column x"):
        read_yearly(spark, f"{tmp_path}/u-*", KINDS, kind="parquet")
    (tmp_path / "plain.csv").write_text("name,n,x\n")
    with pytest.raises(ValueError, match="tells no year"):
        read_yearly(spark, f"{tmp_path}/plain.csv", KINDS)
    for sub in ("a", "b"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "w-2024.csv").write_text("name,n,x\n")
    with pytest.raises(ValueError, match="are of one year"):
        read_yearly(spark, f"{tmp_path}/[ab]/w-*.csv", KINDS)
