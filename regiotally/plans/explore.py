"""Summaries of the merged table: the numbers behind each exploratory figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regiotally.functions.calendar import month_label, period_label
from regiotally.functions.labels import without_code
from regiotally.functions.nulls import all_known, total
from regiotally.functions.numeric import mean_of_rounded, rate_per, round_even, share_pct
from regiotally.operators.combine import attach, attach_null_safe
from regiotally.operators.impute import whole_numbers
from regiotally.operators.reshape import by_listed_order, grouped_total, listed, pivot_single, pivot_total, unique_keys
from regiotally.operators.stats import pearson, skew_adjusted
from regiotally.operators.summary import flag_extreme
from regiotally.plans.prepare import filled_supply, roll_up
from regiotally.plans.spec import Study


def population_by_year(merged: DataFrame, study: Study, years) -> DataFrame:
    """Population per region, one column per year, regions in report order."""
    c = study.incidents
    once = merged.groupBy(c.region, c.year).agg(F.max(study.total_population).alias("population"))
    wide = pivot_single(once, [c.region], c.year, "population", years, "y")
    return by_listed_order(wide, c.region, study.regions)


def category_by_year(incidents: DataFrame, study: Study, years) -> DataFrame:
    """Incidents per category and year, code stripped from the label, sorted by the first year."""
    c = study.incidents
    wide = pivot_total(incidents, [c.category], c.year, c.count, years, "y")
    return wide.withColumn(c.category, without_code(c.category)).orderBy(f"y{years[0]}", c.category)


def involvement(incidents: DataFrame, study: Study) -> DataFrame:
    """Incidents with and without each flag, and their shares, from one aggregate."""
    c = study.incidents
    sums, cells = [], []
    for i, flag in enumerate(c.flags):
        for value in (1, 0):
            counted = F.sum(F.when(F.col(flag) == value, F.col(c.count)))
            sums.append(F.coalesce(counted, F.lit(0)).alias(f"n{i}_{value}"))
        yes, no = F.col(f"n{i}_1"), F.col(f"n{i}_0")
        cells.append(
            F.struct(
                F.lit(flag).alias("flag"),
                yes.alias("involved"),
                no.alias("not_involved"),
                round_even(share_pct(yes, yes + no), 1).alias("involved_pct"),
                round_even(share_pct(no, yes + no), 1).alias("not_involved_pct"),
            )
        )
    return incidents.agg(*sums).select(F.inline(F.array(*cells)))


def monthly_totals(incidents: DataFrame, study: Study) -> DataFrame:
    """Incidents by month of the year, with the peak marked."""
    c = study.incidents
    months = grouped_total(incidents, [c.month], [c.count]).withColumn("month_label", month_label(c.month))
    return flag_extreme(months, c.count, "is_peak").orderBy(c.month)


def monthly_by_year(merged: DataFrame, study: Study) -> DataFrame:
    """Incidents and rate per 100,000 by year and month.

    The population of a year is the sum over the regions that have incidents in it. Incidents are read once, as months
    of a region; windows over these few cells find each region's population once a year.
    """
    c = study.incidents
    cells = merged.groupBy(c.year, c.month, c.region).agg(total(c.count).alias(c.count), F.max(study.total_population).alias("_people"))
    of_region = W.partitionBy(c.year, c.region)
    once = (F.row_number().over(of_region.orderBy(c.month)) == 1) & F.col(c.region).isNotNull()
    counted = cells.withColumn("_once", F.when(once, F.max("_people").over(of_region)))
    peopled = counted.withColumn("_population", F.sum("_once").over(W.partitionBy(c.year)))
    months = peopled.filter(all_known([c.year, c.month])).groupBy(c.year, c.month).agg(
        total(c.count).alias(c.count), F.max("_population").alias("population")
    )
    return months.withColumns(
        {
            "rate_per_100k": round_even(rate_per(c.count, "population"), 1),
            "month_label": month_label(c.month),
        }
    )


def monthly_trend(merged: DataFrame, study: Study) -> DataFrame:
    c = study.incidents
    months = grouped_total(merged, [c.year, c.month], [c.count])
    return months.withColumn("month_label", month_label(c.month)).orderBy(c.year, c.month)


def monthly_rate(merged: DataFrame, study: Study) -> DataFrame:
    """Mean over the years of each month's rate, with the peak marked."""
    c = study.incidents
    means = monthly_by_year(merged, study).groupBy(c.month).agg(mean_of_rounded("rate_per_100k", 1).alias("rate_per_100k"))
    # Twelve rows: one task compares each mean with the very value the maximum was taken of.
    peak = F.col("rate_per_100k") == F.max("rate_per_100k").over(W.partitionBy())
    return means.withColumns({"month_label": month_label(c.month), "is_peak": peak}).orderBy(c.month)


def category_month(incidents: DataFrame, study: Study) -> DataFrame:
    """Incidents per category, one column per month of the year."""
    c = study.incidents
    wide = pivot_total(incidents, [c.category], c.month, c.count, range(1, 13), "m")
    return wide.withColumn(c.category, without_code(c.category)).orderBy(c.category)


def month_cells(merged: DataFrame, study: Study, digits: int = 1) -> DataFrame:
    """All incidents (``_all``) and those of the chosen category, by month and region, from one aggregate.

    Without rows of the category (``_rows`` is 0), or with an unknown key, the columns of the category are null. Flag sums
    count merged rows, not incidents. Supply and population are constant within a cell, so the maximum is their value
    whatever the row order. The category is picked inside the sums: a filter would reach only one of the two readers of
    the incidents below, and they would be joined twice.
    """
    c, p = study.incidents, study.panel
    keys = [c.year, c.quarter, c.month, c.region]
    of = lambda name: F.when(_chosen(study), F.col(name))
    sums = [F.max(of(p.supply[0])).alias(p.supply[1]), F.max(of(study.total_population)).alias(p.population)]
    return _rated(merged.groupBy(*keys).agg(*_counted(study), *sums, *[F.max(of(n)).alias(n) for n in p.extra]), study, digits)


def _chosen(study: Study) -> Column:
    c = study.incidents
    return (F.col(c.category) == study.panel.category) & all_known([c.year, c.quarter, c.month, c.region])


def _counted(study: Study) -> list[Column]:
    """All incidents, and rows, incidents and flags of the chosen category."""
    c, chosen = study.incidents, _chosen(study)
    sums = [total(c.count).alias("_all"), F.count_if(chosen).alias("_rows"), F.sum(F.when(chosen, F.col(c.count))).alias("_target")]
    return sums + [F.sum(F.when(chosen, F.col(flag))).alias(alias) for flag, alias in study.panel.flags]


def _rated(counted: DataFrame, study: Study, digits: int) -> DataFrame:
    c, p = study.incidents, study.panel
    cells = counted.withColumn(p.target, F.when(F.col("_rows") > 0, F.coalesce("_target", F.lit(0))))
    names = [p.target, *[alias for _, alias in p.flags], p.supply[1], p.population, *p.extra]
    rate = round_even(rate_per(p.target, p.population), digits).alias(p.rate)
    return cells.select(c.year, c.quarter, c.month, c.region, *names, rate, "_all", "_rows")


def joined_cells(clean: DataFrame, population: DataFrame, supply: DataFrame, study: Study, digits: int = 1) -> DataFrame:
    """``month_cells`` of the merged table, without building that table: months are counted first and joined then.

    Supply and population meet a row per region and month in place of one per combination of dimensions. Gaps of the
    supply are filled with the weights that the merged rows give, and a gap without a mean fails the job as there.
    """
    c, p = study.incidents, study.panel
    months = roll_up(clean, study).groupBy(c.year, c.quarter, c.month, c.region).agg(*_counted(study), F.count(F.lit(1)).alias("_merged"))
    filled = filled_supply(months, unique_keys(supply, c.cell), study, rows="_merged")
    people = unique_keys(population, [c.year, c.region])
    joined = whole_numbers(attach(attach_null_safe(months, filled, c.cell), people, [c.year, c.region]), study.measures)
    of = lambda name: F.when(F.col("_rows") > 0, F.col(name))
    return _rated(joined.withColumns({p.supply[1]: of(p.supply[0]), p.population: of(study.total_population), **{n: of(n) for n in p.extra}}), study, digits)


def target_cells(merged: DataFrame, study: Study, digits: int = 1) -> DataFrame:
    """The chosen category by month and region."""
    return chosen_cells(month_cells(merged, study, digits))


def chosen_cells(cells: DataFrame) -> DataFrame:
    """Of ``month_cells`` or ``joined_cells`` those that have the chosen category."""
    return cells.filter("_rows > 0").drop("_all", "_rows")


def target_by_region_year(cells: DataFrame, study: Study, years) -> DataFrame:
    """Totals and mean monthly rates per region, one column each per year, with the sum and mean over years."""
    c, p = study.incidents, study.panel
    yearly = cells.groupBy(c.region, c.year).agg(
        F.sum(p.target).alias("total"), round_even(mean_of_rounded(p.rate, 1), 1).alias("rate")
    )
    yearly = yearly.withColumn(c.year, listed(c.year, years))
    columns = []
    for y in years:
        here = F.col(c.year) == y
        columns += [F.max(F.when(here, F.col(n))).alias(f"{n}_{y}") for n in ("total", "rate")]
    columns += [F.sum("total").alias("total_all"), F.avg("rate").alias("mean_rate")]
    return by_listed_order(yearly.groupBy(c.region).agg(*columns), c.region, study.regions)


def target_by_month_region(cells: DataFrame, study: Study) -> DataFrame:
    c, p = study.incidents, study.panel
    means = cells.groupBy(c.month, c.region).agg(F.avg(p.target).alias("mean_count"))
    return means.withColumn("month_label", month_label(c.month)).orderBy(c.region, c.month)


def supply_trend(cells: DataFrame, study: Study) -> DataFrame:
    """Supply per quarter and region in thousands, with a period label."""
    c, p = study.incidents, study.panel
    quarters = cells.groupBy(c.year, c.quarter, c.region).agg(F.max(p.supply[1]).alias("supply"))
    return quarters.withColumns(
        {"period": period_label(c.year, c.quarter), "supply_thousands": F.col("supply") / 1000}
    ).orderBy(c.region, c.year, c.quarter)


def skewness(cells: DataFrame, study: Study) -> DataFrame:
    """Skewness of the counts, raw and after log(1 + x)."""
    p = study.panel
    logs = cells.select(F.col(p.target).cast("double").alias("raw"), F.log1p(p.target).alias("log"))
    return logs.agg(skew_adjusted("raw").alias("skew_raw"), skew_adjusted("log").alias("skew_log"))


def findings(cells: DataFrame, study: Study, years) -> DataFrame:
    """Peak month, region with the highest rate, correlation and skewness, as one row, from ``month_cells`` or ``joined_cells``.

    All of it comes from one pass over these cells: grouping sets total them by month, by region and year, and as a whole,
    and one more aggregate picks the largest (the earlier month or name on ties). A listed region without a row fails
    the job.
    """
    c, p = study.incidents, study.panel
    year = F.when(F.col("_rows") > 0, listed(c.year, years)).otherwise(F.col(c.year))
    cells = cells.withColumns({c.year: year, "_log": F.log1p(p.target), "_raw": F.col(p.target).cast("double")})
    sets = cells.groupingSets([[c.month], [c.region, c.year], []], c.month, c.region, c.year).agg(
        F.grouping_id().alias("_set"),
        F.sum("_all").alias("_all"),
        round_even(mean_of_rounded(p.rate, 1), 1).alias("_rate"),
        pearson(p.supply[1], p.target).alias("supply_r"),
        skew_adjusted("_raw").alias("skew_raw"),
        skew_adjusted("_log").alias("skew_log"),
    )
    by_month, by_region, whole = 3, 4, 7  # bits of the columns that a set leaves out
    means = sets.groupBy("_set", c.month, c.region).agg(F.avg("_rate").alias("_rate"), *[F.max(n).alias(n) for n in ("_all", "supply_r", "skew_raw", "skew_log")])
    month, region = F.col("_set") == by_month, (F.col("_set") == by_region) & F.col("_rate").isNotNull() & F.col(c.region).isin(*study.regions)
    row = means.agg(
        F.max_by(c.month, F.when(month & F.col(c.month).isNotNull(), F.struct("_all", -F.col(c.month)))).alias("_month"),
        F.min_by(F.struct(c.region, "_rate"), F.when(region, F.struct(-F.col("_rate"), F.col(c.region)))).alias("_top"),
        F.count_if(region).alias("_regions"),
        *[F.max(F.when(F.col("_set") == whole, F.col(n))).alias(n) for n in ("supply_r", "skew_raw", "skew_log")],
    )
    lacking = F.raise_error(F.lit(f"{c.region} lacks a listed level")).cast("string")
    return row.select(
        month_label("_month").alias("peak_month"),
        F.when(F.col("_regions") < len(study.regions), lacking).otherwise(F.col("_top")[c.region]).alias("top_region"),
        F.col("_top")["_rate"].alias("top_rate"),
        "supply_r",
        "skew_raw",
        "skew_log",
    )
