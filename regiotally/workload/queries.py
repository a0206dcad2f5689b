"""One query per operator or report, over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regiotally.functions.calendar import month_label, period_label, quarter_of_month, quarter_of_quarter_end
from regiotally.functions.labels import before_colon, fixed, thousands, without_code
from regiotally.functions.nulls import differs_or_null, first_known
from regiotally.functions.numeric import round_even
from regiotally.operators import checks, stats
from regiotally.operators.combine import append, one_hot
from regiotally.operators.diagnostics import inflation_factors, kolmogorov_smirnov
from regiotally.operators.encode import fit_encoder
from regiotally.operators.impute import fill_group_mean, whole_numbers
from regiotally.operators.panel import add_lags, complete_months
from regiotally.operators.recode import drop_unmapped, lookup_strict, recode_by_table, recode_pairs, region_from_area, unmapped
from regiotally.operators.reshape import by_listed_order, distinct_sorted, grouped_total, pivot_count, pivot_total
from regiotally.operators.scaling import standardize
from regiotally.plans import explore, forecast
from regiotally.plans.prepare import join_profile, prepare_observed, stage_counts
from regiotally.sources.delimited import read_delimited, read_with_rejects, write_delimited
from regiotally.sources.staging import removed, staged_path
from regiotally.sources.yearly import read_yearly
from regiotally.workload import tables as t

TRADE, YEARS = t.TRADE, t.YEARS
TRAIN = "year < 2000"
TEST = "year = 2000"


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    """Cut the noise of summation order from computed doubles."""
    return df.withColumns({c: round_even(c, digits) for c in columns})


# Recodes and scalars ------------------------------------------------------------------------------


def region_recode(spark: SparkSession, d: str) -> DataFrame:
    """Customers per recoded region; the places are recoded, not the customers."""
    r = TRADE.recode
    region = region_from_area("r_name", "n_name", r.balance, r.areas, r.regions, r.fallback)
    counted = t.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    named = counted.join(t.places(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy(region.alias("region")).agg(F.sum("customers").alias("customers"))


def _pair_table(spark: SparkSession) -> DataFrame:
    """The recode of the study as a table: areas of the balance region, its fallback, and the other regions."""
    r = TRADE.recode
    rows = [(r.balance, area, region) for area, region in r.areas.items()] + [(r.balance, None, r.fallback)]
    rows += [(region, None, name) for region, name in r.regions.items() if region != r.balance]
    return spark.createDataFrame(rows, "first string, second string, value string")


def _counted_places(spark: SparkSession, d: str) -> DataFrame:
    counted = t.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return counted.join(t.places(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))


def pair_recode(spark: SparkSession, d: str) -> DataFrame:
    """Customers per region and kind of match, recoded by region and nation through a table."""
    named = recode_pairs(_counted_places(spark, d), "r_name", "n_name", _pair_table(spark), "region")
    return named.groupBy("region", "match").agg(F.sum("customers").alias("customers"))


def unmapped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations that the recode table does not list."""
    return unmapped(recode_pairs(_counted_places(spark, d), "r_name", "n_name", _pair_table(spark), "region"), "r_name", "n_name")


def strict_flag_recode(spark: SparkSession, d: str) -> DataFrame:
    lines = t.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    flags = lines.select(
        lookup_strict("l_returnflag", {"R": 1, "A": 0, "N": 0}).alias("returned"),
        lookup_strict("l_linestatus", {"F": 1, "O": 0}).alias("filled"),
    )
    return flags.groupBy("returned", "filled").agg(F.count(F.lit(1)).alias("lines"))


def lenient_recode_sum(spark: SparkSession, d: str) -> DataFrame:
    """Segments fall into two groups; those not listed leave the table."""
    groups = {"AUTOMOBILE": "goods", "MACHINERY": "goods", "HOUSEHOLD": "home", "FURNITURE": "home"}
    customers = t.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"))
    counted = customers.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    return grouped_total(drop_unmapped(counted, "segment", groups), ["segment"], ["customers"])


def table_recode(spark: SparkSession, d: str) -> DataFrame:
    """Recode through a lookup table instead of literals."""
    suppliers = t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    named = recode_by_table(suppliers, "nation", t.table(spark, d, "nation"), "n_nationkey", "n_name", "nation_name")
    return named.groupBy("nation_name").agg(F.count(F.lit(1)).alias("suppliers"))


def not_equal_keeps_null(spark: SparkSession, d: str) -> DataFrame:
    """Orders left by a null-keeping filter on a status that is null for pending orders."""
    orders = t.table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    kept = orders.filter(differs_or_null("status", "F"))
    return kept.groupBy("status").agg(F.count(F.lit(1)).alias("orders"))


def quarter_month_labels(spark: SparkSession, d: str) -> DataFrame:
    months = t.table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return months.select("month", quarter_of_month("month").alias("quarter"), month_label("month").alias("label"), "orders")


def quarter_end_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Strict quarter of the quarter-end dates of the supply table."""
    ends = t.supply_rows(spark, d).select("quarter_ending").distinct()
    return ends.select(
        F.year("quarter_ending").alias("year"),
        F.month("quarter_ending").alias("month"),
        quarter_of_quarter_end("quarter_ending").alias("quarter"),
    )


def label_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    label = F.concat(F.lit("0"), F.replace("o_orderpriority", F.lit("-"), F.lit(" ")))
    return rows.select(
        label.alias("label"),
        without_code(label).alias("name"),
        before_colon(F.concat_ws(": ", F.col("o_orderpriority"), F.lit("x"))).alias("prefix"),
        thousands("orders").alias("orders_text"),
        fixed(F.col("orders") / 7, 1).alias("orders_fixed"),
    )


def period_labels(spark: SparkSession, d: str) -> DataFrame:
    quarters = t.table(spark, d, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")
    ).agg(F.count(F.lit(1)).alias("orders"))
    return quarters.select(period_label("year", "quarter").alias("period"), "orders")


# Dimensions and the merged table --------------------------------------------------------------------


def population_features(spark: SparkSession, d: str) -> DataFrame:
    return t.population(spark, d)


def supply_rollup(spark: SparkSession, d: str) -> DataFrame:
    return t.supply(spark, d)


def append_years(spark: SparkSession, d: str) -> DataFrame:
    """Two tables, the earlier one without the second measure; together they have all years."""
    rows, later = t.supply_rows(spark, d), F.year("quarter_ending") >= 1998
    early, late = rows.filter(~later).drop("returned_supply"), rows.filter(later)
    stacked = append([early, late]).withColumn("year", F.year("quarter_ending"))
    return stacked.groupBy("year", "region").agg(
        F.sum("supply").alias("supply"), F.sum("returned_supply").alias("returned_supply")
    )


def merged_table(spark: SparkSession, d: str) -> DataFrame:
    return t.merged(spark, d)


def imputed_supply(spark: SparkSession, d: str) -> DataFrame:
    """Row-level fill of the gaps in the merged rows by region and quarter."""
    c = TRADE.incidents
    filled = fill_group_mean(t.with_supply(spark, d), ["supply"], [c.region, c.quarter])
    whole = whole_numbers(filled, ["supply"])
    return whole.groupBy(*c.cell).agg(F.max("supply").alias("supply"), F.count(F.lit(1)).alias("rows"))


def onehot_region(spark: SparkSession, d: str) -> DataFrame:
    customers = t.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    named = customers.join(t.places(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = named.select(t.region_of("r_name", "n_name").alias("region"), "n_name", "customers")
    return one_hot(rows, "region", TRADE.regions, TRADE.reference, "region_")


def encoded_shipments(spark: SparkSession, d: str) -> DataFrame:
    """Quantity by dummy columns of the line status, levels found in the lines up to 1997 and used on all.

    Levels are those of returns and status together; a level that only later lines have is told by its own flag.
    """
    lines = t.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_linestatus", (F.year("l_shipdate") > 1998).cast("string")).alias("state"), "l_shipdate", "l_quantity"
    )
    encoder = fit_encoder(lines.filter(F.year("l_shipdate") <= 1998), "state", "is_", reference="A-F-false")
    coded = encoder.apply(lines, unknown="is_new")
    return coded.groupBy(*encoder.names, "is_new").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def first_orders(spark: SparkSession, d: str) -> DataFrame:
    """First known status and priority of each customer by date, where the status of pending orders is not known."""
    orders = t.table(spark, d, "orders").select("o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_orderpriority", "o_orderdate", "o_orderkey")
    order = ("o_orderdate", "o_orderkey")
    return orders.groupBy("o_custkey").agg(
        first_known("status", *order).alias("status"), first_known("o_orderpriority", *order).alias("priority")
    )


def null_profile(spark: SparkSession, d: str) -> DataFrame:
    """Columns with nulls after the left join of supply, before any filling."""
    return checks.null_counts(t.with_supply(spark, d))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return checks.coverage(t.supply(spark, d), ["year", "quarter"], "n_regions")


def rowcount_matrix(spark: SparkSession, d: str) -> DataFrame:
    return pivot_count(t.rolled(spark, d), ["region"], "year", t.years(spark, d), "y")


def region_list(spark: SparkSession, d: str) -> DataFrame:
    return distinct_sorted(t.clean(spark, d), "region")


def load_counts(spark: SparkSession, d: str) -> DataFrame:
    return stage_counts(t.incident_rows(spark, d), TRADE, "reporting_region", "source_rows")


def join_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Nulls after each join of the merged table."""
    return join_profile(t.clean(spark, d), t.population(spark, d), t.reported_supply(spark, d), TRADE)


def observed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Row and null counts of every step, told by the one job that writes the merged table."""
    raw = t.incident_rows(spark, d)
    merged, points = prepare_observed(
        raw, t.population(spark, d), t.reported_supply(spark, d), TRADE, "reporting_region", "area", ["source_rows"], "source_rows"
    )
    path = staged_path(spark, "merged")
    try:
        merged.write.parquet(path)
    finally:
        removed(spark, path)
    return points.row(spark)


def delimited_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The merged table written as headed text and read again with declared types."""
    merged = t.merged(spark, d)
    path = staged_path(spark, "delimited")
    write_delimited(merged, path)
    return read_delimited(spark, path, merged.schema)


def load_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a text file in which some prices and keys are no numbers: clean rows and rejects by reason."""
    orders = t.table(spark, d, "orders")
    price = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.col("o_totalprice").cast("string"), F.lit(" USD"))).otherwise(F.col("o_totalprice").cast("string"))
    status = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_orderstatus"))
    path = staged_path(spark, "orders")
    write_delimited(orders.select("o_orderkey", status.alias(" o_orderstatus "), price.alias("o_totalprice")), path)
    schema = t.schema_of("o_orderkey long, o_orderstatus string, o_totalprice double")
    clean, rejects = read_with_rejects(spark, path, schema, required=["o_orderstatus"])
    kept = clean.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("rows"))
    return kept.unionByName(rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))


def yearly_files(spark: SparkSession, d: str) -> DataFrame:
    """Supply written as one folder a year and read as one table, with the year that the folder tells."""
    rows = t.supply_rows(spark, d)
    path = staged_path(spark, "supply")
    found = [r[0] for r in rows.select(F.year("quarter_ending").alias("year")).distinct().orderBy("year").collect()]
    whole = rows.persist()  # one reader a year
    for year in found:
        write_delimited(whole.filter(F.year("quarter_ending") == year), f"{path}/supply-{year}.csv")
    whole.unpersist()
    read = read_yearly(spark, f"{path}/supply-*.csv", rows.schema)
    return read.groupBy("file_year", "region").agg(F.sum("supply").alias("supply"), F.count(F.lit(1)).alias("rows"))


def final_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the merged table that still hold nulls."""
    return checks.null_counts(t.merged(spark, d))


def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first three merged rows in key order: three rows are the report."""
    names = ["year", "quarter", "month", "region", "category", "kind", "returned", "filled"]
    return t.with_population(spark, d).select(*names, "incidents", "total_population").orderBy(*names).limit(3)


# Exploration ----------------------------------------------------------------------------------------


def population_by_year(spark: SparkSession, d: str) -> DataFrame:
    return explore.population_by_year(t.with_population(spark, d), TRADE, t.years(spark, d))


def category_by_year(spark: SparkSession, d: str) -> DataFrame:
    return explore.category_by_year(t.clean(spark, d), TRADE, t.years(spark, d))


def involvement_share(spark: SparkSession, d: str) -> DataFrame:
    return explore.involvement(t.clean(spark, d), TRADE)


def monthly_total_peak(spark: SparkSession, d: str) -> DataFrame:
    return explore.monthly_totals(t.clean(spark, d), TRADE)


def monthly_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(explore.monthly_rate(t.with_population(spark, d), TRADE), ["rate_per_100k"])


def monthly_rate_by_year(spark: SparkSession, d: str) -> DataFrame:
    return explore.monthly_by_year(t.with_population(spark, d), TRADE)


def monthly_trend(spark: SparkSession, d: str) -> DataFrame:
    return explore.monthly_trend(t.clean(spark, d), TRADE)


def category_month_matrix(spark: SparkSession, d: str) -> DataFrame:
    return explore.category_month(t.clean(spark, d), TRADE)


def event_hour_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour of the day, one column per type."""
    events = t.table(spark, d, "events").select(F.hour("ts").alias("hour"), "event_type")
    return pivot_count(events, ["hour"], "event_type")


def event_daily_lags(spark: SparkSession, d: str) -> DataFrame:
    """Daily events per type with the counts one and three rows before."""
    days = t.table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return add_lags(days, "event_type", ["day"], "n", (1, 3), "lag")


def cells(spark: SparkSession, d: str, digits: int = 1) -> DataFrame:
    return explore.chosen_cells(t.month_cells(spark, d, digits))


def assault_cells(spark: SparkSession, d: str) -> DataFrame:
    return explore.target_cells(t.merged(spark, d), TRADE)


def assault_region_year(spark: SparkSession, d: str) -> DataFrame:
    wide = explore.target_by_region_year(cells(spark, d), TRADE, t.years(spark, d))
    return rounded(wide, ["mean_rate"])


def assault_month_region(spark: SparkSession, d: str) -> DataFrame:
    return rounded(explore.target_by_month_region(cells(spark, d), TRADE), ["mean_count"])


def supply_trend(spark: SparkSession, d: str) -> DataFrame:
    return explore.supply_trend(cells(spark, d), TRADE)


def skewness_raw_log(spark: SparkSession, d: str) -> DataFrame:
    return rounded(explore.skewness(cells(spark, d), TRADE), ["skew_raw", "skew_log"])


def histogram30(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.histogram(cells(spark, d), "incidents"), ["from_value", "to_value"])


def histogram30_log(spark: SparkSession, d: str) -> DataFrame:
    logs = cells(spark, d).select(F.log1p("incidents").alias("log_incidents"))
    return rounded(stats.histogram(logs, "log_incidents"), ["from_value", "to_value"])


def density_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.density(cells(spark, d), "incidents", bins=30), ["x", "density", "curve"], 9)


def density_grid_log(spark: SparkSession, d: str) -> DataFrame:
    logs = cells(spark, d).select(F.log1p("incidents").alias("log_incidents"))
    return rounded(stats.density(logs, "log_incidents", bins=30), ["x", "density", "curve"], 9)


def trend_line(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).select((F.col("supply") / 1000).alias("supply_thousands"), "incidents")
    return rounded(stats.trend_line(rows, "supply_thousands", "incidents"), ["x", "y"])


def corr_pair(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cells(spark, d).agg(stats.pearson("supply", "incidents").alias("r")), ["r"])


def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    names = ["incidents", "supply", "total_population", "credit", "returned_rows", "filled_rows"]
    labels = {"incidents": "Incidents", "total_population": "Total Population"}
    return rounded(stats.correlation_matrix(cells(spark, d), names, labels), ["r"])


def corr_wide(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the monthly incidents of every pair of kinds, from two vector aggregates."""
    months = grouped_total(t.clean(spark, d), ["year", "month", "kind"], ["incidents"])
    wide = pivot_total(months, ["year", "month"], "kind", "incidents").persist()
    names = [n for n in wide.columns if n not in ("year", "month")]
    table = rounded(stats.correlation_wide(wide, names), ["r"])
    wide.unpersist()
    return table


def price_normality(spark: SparkSession, d: str) -> DataFrame:
    """Kolmogorov-Smirnov test of all order prices against the normal distribution of their mean and deviation."""
    prices = t.table(spark, d, "orders").select("o_totalprice", "o_orderkey")
    return rounded(kolmogorov_smirnov(prices, "o_totalprice", ["o_orderkey"]), ["distance", "p_value"], 9)


def findings_summary(spark: SparkSession, d: str) -> DataFrame:
    row = explore.findings(t.month_cells(spark, d), TRADE, t.years(spark, d))
    return rounded(row, ["top_rate", "supply_r", "skew_raw", "skew_log"])


def listed_regions(spark: SparkSession, d: str) -> DataFrame:
    """Incidents per region in report order."""
    totals = grouped_total(t.clean(spark, d), ["region"], ["incidents"])
    return by_listed_order(totals, "region", TRADE.regions)


# Panel ----------------------------------------------------------------------------------------------


def panel_features(spark: SparkSession, d: str) -> DataFrame:
    p = TRADE.panel
    return rounded(panel(spark, d), ["sin_month", "cos_month", p.log_rate, p.per_head], 9)


def lag_features(spark: SparkSession, d: str) -> DataFrame:
    """Monthly incidents per region and category with positional lags."""
    months = grouped_total(t.clean(spark, d), ["region", "category", "year", "month"], ["incidents"])
    keyed = months.withColumn("series", F.concat_ws("/", "region", "category"))
    return add_lags(keyed, "series", ["year", "month"], "incidents", (1, 3), "lag").drop("series")


def calendar_lags(spark: SparkSession, d: str) -> DataFrame:
    """Lags by calendar: months without incidents are added before the rows are counted."""
    months = grouped_total(t.clean(spark, d), ["region", "year", "month"], ["incidents"])
    spine = complete_months(months, "region", "year", "month")
    return add_lags(spine, "region", ["year", "month"], "incidents", (1, 3), "lag")


def panel(spark: SparkSession, d: str) -> DataFrame:
    return forecast.panel_of_cells(cells(spark, d, digits=2), TRADE)


def train_test_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    train, test = (F.count_if(F.expr(condition)) for condition in (TRAIN, TEST))
    return rows.agg(F.count(F.lit(1)).alias("rows"), train.alias("train"), test.alias("test"))


# Models ---------------------------------------------------------------------------------------------


def study(spark: SparkSession, d: str) -> forecast.Forecast:
    return forecast.Forecast.of_panel(panel(spark, d), TRADE, TRAIN, TEST)


def standardized(spark: SparkSession, d: str) -> DataFrame:
    names = ["rate_lag1", "rate_lag3", "supply_per_head"]
    rows = standardize(panel(spark, d), names)
    return rounded(rows.select("region", "year", "month", *[f"z_{n}" for n in names]), [f"z_{n}" for n in names])


def vif(spark: SparkSession, d: str) -> DataFrame:
    table = inflation_factors(panel(spark, d).filter(TRAIN), ["rate_lag1", "supply_per_head"])
    return rounded(table, ["vif"])


def vif_chosen(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).inflation(), ["vif"])


def feature_ablation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).variants(), ["rmse", "mae"])


def ridge_grid_time_order(spark: SparkSession, d: str) -> DataFrame:
    """The same grid with folds in true time order."""
    ordered = forecast.Forecast.of_panel(panel(spark, d), TRADE, TRAIN, TEST, time_order=True)
    return rounded(ordered.alpha_grid().filter(F.col("penalty") == "ridge"), ["cv_rmse"])


def alpha_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).alpha_grid(), ["cv_rmse"])


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    table = rounded(study(spark, d).leaderboard(), ["rmse", "mae"])
    return rounded(rounded(table, ["cv_rmse"], 4), ["rmse_rate"], 2)


def coefficients(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).coefficients(), ["ridge", "lasso"])


def residuals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).residuals(), ["fitted", "residual"])


def qq_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).quantiles(), ["level", "theoretical", "ordered"])


def qq_line(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).quantile_fit(), ["slope", "intercept", "r"])


def shapiro_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).normality(), ["w", "p_value"])


def model_significance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).significance(), ["t_stat", "p_value"])


def chosen_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Forecast of the model with the smallest validation error."""
    return study(spark, d).predictions()


def forecast_rows(spark: SparkSession, d: str) -> DataFrame:
    return chosen_forecast(spark, d).drop("actual_exact", "predicted_exact")


def forecast_best_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(study(spark, d).predictions(), ["actual_exact", "predicted_exact"], 3)


def forecast_by_region(spark: SparkSession, d: str) -> DataFrame:
    report = forecast.report_by_region(chosen_forecast(spark, d), "region")
    return rounded(report, ["avg_actual", "avg_predicted", "rmse", "mean_pct_error"], 3)


def overall_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.overall_errors(chosen_forecast(spark, d)), ["rmse", "mae"], 2)


def best5(spark: SparkSession, d: str) -> DataFrame:
    return forecast.closest(chosen_forecast(spark, d), TRADE).drop("actual_exact", "predicted_exact")


def worst5(spark: SparkSession, d: str) -> DataFrame:
    return forecast.farthest(chosen_forecast(spark, d), TRADE).drop("actual_exact", "predicted_exact")


QUERIES = [
    region_recode, pair_recode, unmapped_pairs, strict_flag_recode, lenient_recode_sum, table_recode, not_equal_keeps_null,
    quarter_month_labels, quarter_end_quarters, label_strip, period_labels,
    population_features, supply_rollup, append_years, merged_table, imputed_supply, onehot_region, encoded_shipments, first_orders,
    null_profile, coverage, rowcount_matrix, region_list, load_counts, join_nulls, observed_counts, delimited_round_trip, load_rejects, yearly_files, final_nulls, sample_rows,
    population_by_year, category_by_year, involvement_share, monthly_total_peak, monthly_rate,
    monthly_rate_by_year, monthly_trend, category_month_matrix, event_hour_matrix, event_daily_lags,
    assault_cells, assault_region_year, assault_month_region, supply_trend, skewness_raw_log,
    histogram30, histogram30_log, density_grid, density_grid_log, trend_line, corr_pair, corr_matrix, corr_wide, price_normality, findings_summary,
    listed_regions, panel_features, lag_features, calendar_lags, train_test_rows,
    standardized, vif, vif_chosen, feature_ablation, ridge_grid_time_order, alpha_grid,
    leaderboard, coefficients, residuals, qq_positions, qq_line,
    shapiro_test, model_significance, forecast_rows, forecast_best_model,
    forecast_by_region, overall_error, best5, worst5,
]
