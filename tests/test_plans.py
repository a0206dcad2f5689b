"""Shape of the physical plans: what is read, what is joined how, and that rows stay in the JVM."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from regiotally.workload import tables

FOLDER = "/root/testdata/sf0.001"
LAZY = [
    "region_recode", "strict_flag_recode", "population_features", "supply_rollup", "append_years", "load_counts",
    "category_by_year", "monthly_total_peak", "involvement_share", "category_month_matrix", "lag_features", "calendar_lags",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(registry.queries()[name](spark, FOLDER))
    assert not re.search("CartesianProduct|NestedLoop|EvalPython|MapInPandas|FlatMapGroups", plan)


def test_scans_read_only_what_is_used(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = plan_of(tables.incident_rows(spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    names = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert {c for c in names if c.startswith("l_")} == {"l_orderkey", "l_quantity", "l_returnflag", "l_discount", "l_linenumber", "l_tax"}
    assert {c for c in names if c.startswith("c_")} == {"c_custkey", "c_nationkey"}
    assert "SortMergeJoin [l_orderkey" in plan


def test_date_ranges_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate,1995", plan_of(tables.population_rows(spark, FOLDER)))
    # the year that is left out, with orders without a date kept
    assert re.search(r"PushedFilters: \[[^\]]*Or\(.*IsNull\(o_orderdate\).*2001-01-01", plan_of(tables.clean(spark, FOLDER)))


def test_building_the_merged_table_starts_no_job(spark, tmp_path):
    tracker, group = spark.sparkContext.statusTracker(), "building"
    spark.sparkContext.setJobGroup(group, group)
    try:
        df = registry.queries()["merged_table"](spark, FOLDER)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not tracker.getJobIdsForGroup(group)
    assert not re.search("CartesianProduct|NestedLoop", plan_of(df))
    df.collect()
    assert "ReusedExchange" in plan_of(df)


ONE_JOIN = ["merged_table", "imputed_supply", "monthly_rate", "corr_matrix", "findings_summary", "join_nulls", "panel_features", "final_nulls", "assault_region_year", "supply_trend"]


@pytest.mark.parametrize("name", ONE_JOIN)
def test_incidents_are_joined_once(spark, name):
    """One scan of the lines by order in the plan that ran, however often their counts are read."""
    df = registry.queries()[name](spark, FOLDER)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"ReadSchema: struct<l_orderkey", final)) == 1
    assert len(re.findall(r"SortMergeJoin \[l_orderkey", final)) == 1


@pytest.mark.parametrize("name", ["histogram30", "density_grid", "trend_line"])
def test_bounds_are_planned_a_few_times_only(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    df.collect()
    whole = plan_of(df).split("== Initial Plan ==")
    assert len(re.findall(r"ReadSchema: struct<l_orderkey", whole[0])) <= 2
    assert len(re.findall(r"ReadSchema: struct<l_orderkey", whole[1])) <= 8  # twenty before bounds were attached as one row


def test_positions_leave_no_boundaries_in_the_plan(spark):
    from regiotally.operators.position import with_position

    df, _ = with_position(spark.range(5_000).select(((F.col("id") * 7) % 5_000).alias("v"), "id"), ["v", "id"], slices=300)
    assert "filter(" not in plan_of(df) and len(plan_of(df)) < 5_000


def test_load_counts_read_the_lines_once(spark):
    plan = plan_of(registry.queries()["load_counts"](spark, FOLDER))
    assert len(re.findall(r"ReadSchema: struct<[^>]*l_orderkey", plan)) == 1


def test_peak_flag_reuses_the_shuffle(spark):
    df = registry.queries()["monthly_total_peak"](spark, FOLDER)
    df.collect()
    assert "ReusedExchange" in plan_of(df)


def test_one_aggregate_serves_all_population_splits(spark):
    plan = plan_of(tables.population(spark, FOLDER))
    assert plan.count("Exchange hashpartitioning(year") == 3  # distinct customers, counts, features


def test_hot_order_and_customer_are_split(spark, tmp_path):
    """A third of the lines in one order, a third of the orders by one customer: split, and counted right."""
    rng = np.random.default_rng(6)
    n = 30_000
    start = datetime.datetime(1995, 1, 1)
    orders = [
        (i, 0 if i % 3 == 0 else int(rng.integers(1, 500)), "O", 1.0, start + datetime.timedelta(days=int(i % 2000)), "1-URGENT")
        for i in range(n // 3)
    ]
    lines = [
        (7 if i % 3 == 0 else int(rng.integers(n // 3)), 1, i % 10, 1, float(rng.integers(1, 50)), 1.0, 0.0, 0.0, "R", "F", start)
        for i in range(n)
    ]
    customers = [(i, "c", i % 25, 1.0, "BUILDING") for i in range(500)]
    for name, rows in [("orders", orders), ("lineitem", lines), ("customer", customers)]:
        frame = spark.createDataFrame(rows, tables.SCHEMAS[name])
        frame.repartition(8).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("nation", "region"):
        tables.table(spark, FOLDER, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = tables.incident_rows(spark, str(tmp_path))
        got = sum(r["incidents"] for r in df.collect())
        assert "skew=true" in plan_of(df)
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert got == sum(int(row[4]) for row in lines)
