"""Registered queries beside their SQL in DuckDB; ``tools/compare.py`` runs all of them."""

import pytest

import __spark_entry__ as registry
from tools.compare import differences, duck

FOLDER = "/root/testdata/sf0.01"
CHECKED = [
    "region_recode", "lenient_recode_sum", "not_equal_keeps_null", "population_features", "append_years",
    "merged_table", "imputed_supply", "null_profile", "involvement_share", "monthly_total_peak", "assault_region_year",
    "histogram30", "corr_matrix", "panel_features", "calendar_lags", "vif", "feature_ablation", "alpha_grid",
    "shapiro_test", "forecast_by_region", "load_counts", "join_nulls", "density_grid_log", "append_years",
    "pair_recode", "unmapped_pairs", "encoded_shipments", "first_orders", "observed_counts", "delimited_round_trip", "load_rejects",
    "yearly_files", "corr_wide", "price_normality",
]


@pytest.fixture(scope="module")
def database():
    return duck(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, database, name):
    _, rows, verdict = differences(spark, database, FOLDER, name, registry.queries()[name], registry.oracle_sql()[name])
    assert rows > 0 and verdict.startswith("ok"), verdict


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    table = registry.entry(spark)
    assert table.columns == ["month", "rate_per_100k", "month_label", "is_peak"]
    assert table.filter("is_peak").count() >= 1


def test_large_joins_sort_when_nothing_may_be_broadcast(spark, database):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("merged_table", "population_features"):
            verdict = differences(spark, database, FOLDER, name, registry.queries()[name], registry.oracle_sql()[name])[2]
            assert verdict.startswith("ok"), verdict
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
