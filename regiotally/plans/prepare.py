"""Sources to one merged analysis table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from regiotally.functions.calendar import quarter_of_month, quarter_of_quarter_end
from regiotally.functions.nulls import differs_or_null, total
from regiotally.operators.combine import append, attach, attach_null_safe, one_hot
from regiotally.operators.impute import fill_weighted_mean, whole_numbers
from regiotally.operators.recode import drop_unmapped, lookup_strict, region_from_area
from regiotally.operators.reshape import grouped_total, totals_by_split, unique_keys
from regiotally.plans.spec import Study


def clean_incidents(raw: DataFrame, study: Study, region: str, area: str, unused=()) -> DataFrame:
    """Drop the unknown region and the partial year, recode regions and flags, add the quarter."""
    c = study.incidents
    place = region_from_area(
        region, area, study.recode.balance, study.recode.areas, study.recode.regions, study.recode.fallback
    )
    kept = raw.filter(kept_rows(study, region))
    flags = {f: lookup_strict(f, study.flag_codes) for f in c.flags}
    placed = kept.withColumns({"_place": place, c.quarter: quarter_of_month(c.month), **flags})
    return placed.drop(region, area, *unused).withColumnRenamed("_place", c.region)


def kept_rows(study: Study, region: str):
    """The rows that stay: a known place and a whole year, nulls kept."""
    return differs_or_null(region, study.unknown_region) & differs_or_null(study.incidents.year, study.partial_year)


def roll_up(clean: DataFrame, study: Study) -> DataFrame:
    """Incident counts by every dimension, null keys kept.

    Grouping comes before the joins: population and supply depend on keys that are already among the
    dimensions, so the result is the same and the joins see cells in place of incidents. A negative count fails the job.
    As every reader of the counts checks them, all of them ask for the same columns, and the planner computes the shuffle
    of the counts, and the joins below it, once however often it is read.
    """
    c = study.incidents
    counts = grouped_total(clean, c.dimensions, [c.count], keep_null_keys=True)
    negative = F.raise_error(F.lit(f"{c.count} is negative")).cast("boolean")
    return counts.filter(F.when(F.col(c.count) < 0, negative).otherwise(True))


def population_features(population: DataFrame, study: Study, years=None) -> DataFrame:
    """Totals by year and region with one column per level of every split."""
    c = study.incidents
    kept = population.filter(F.col(c.year).between(*years)) if years else population
    return totals_by_split(
        kept, [c.year, c.region], "Population", study.total_population, study.population_splits
    )


def supply_by_quarter(frames, study: Study, quarter_ending: str = "Quarter Ending") -> DataFrame:
    """Stack yearly supply tables, recode their regions and sum every measure by quarter and region."""
    c = study.incidents
    stacked = append(frames)
    end = F.to_date(F.col(quarter_ending))
    dated = stacked.withColumns({c.year: F.year(end), c.quarter: quarter_of_quarter_end(end)}).drop(quarter_ending)
    return grouped_total(drop_unmapped(dated, c.region, study.supply_regions), c.cell, study.measures)


def filled_supply(rolled: DataFrame, supply: DataFrame, study: Study, marked: bool = False, rows: str | None = None) -> DataFrame:
    """Supply for every cell that has incidents, gaps filled where the region and quarter have a mean.

    With ``marked`` a flag ``_open_<measure>`` tells of each measure whether it was a gap. ``rows`` is a column of row counts
    where ``rolled`` is rolled up further.

    A gap takes the mean of its region and quarter over the merged rows. Supply is constant in a cell, so
    that mean is the cell mean weighted by the cell's row count, and no row of the fact is touched. Supply
    of cells without incidents does not count.
    """
    c = study.incidents
    cells = rolled.groupBy(*c.cell).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("_rows"))
    known = attach(cells, supply, c.cell)
    if marked:
        known = known.withColumns({f"_open_{m}": F.col(m).isNull() for m in study.measures})
    return fill_weighted_mean(known, study.measures, [c.region, c.quarter], "_rows").drop("_rows")


def merge(rolled: DataFrame, population: DataFrame, supply: DataFrame, study: Study, seen: Observation | None = None) -> DataFrame:
    """Attach population and filled supply, add region flags, arrange the columns.

    ``seen`` counts rows and nulls of the joins on the way, from supply with ``_open_`` flags.

    Supply becomes whole after the join, so a row without a region, which no cell of the supply matches, fails the job
    as a cell without a mean does.
    """
    c = study.incidents
    supplied = attach_null_safe(rolled, supply, c.cell)
    joined = attach(supplied, population, [c.year, c.region])
    if seen is not None:
        joined = joined.observe(seen, *_null_sums(study))
    joined = whole_numbers(joined, study.measures)
    encoded = one_hot(joined, c.region, study.regions, study.reference, study.region_prefix)
    plain = [n for s in study.population_splits for n in map(s.rename, s.levels) if not n.startswith(study.split_prefix)]
    split = sorted(
        n for s in study.population_splits for n in map(s.rename, s.levels) if n.startswith(study.split_prefix)
    )
    dummies = [f"{study.region_prefix}{v}" for v in sorted(study.regions) if v != study.reference]
    names = [*c.dimensions, study.total_population, *plain, *split, *study.measures, c.count, *dummies]
    return encoded.select(*[F.col(f"`{n}`") for n in names])


def prepare(clean: DataFrame, population: DataFrame, supply: DataFrame, study: Study) -> DataFrame:
    """The merged table from cleaned incidents, population features and quarterly supply: one lazy plan.

    The counts feed both the fill and the join; the planner reads their shuffle twice instead of computing it twice
    (``tests/test_plans.py`` holds the final plan to one scan).
    A dimension with two rows for a key fails the job.
    """
    c = study.incidents
    counts = roll_up(clean, study)
    people, quarters = unique_keys(population, [c.year, c.region]), unique_keys(supply, c.cell)
    return merge(counts, people, filled_supply(counts, quarters, study), study)


def stage_counts(loaded: DataFrame, study: Study, region: str, rows: str | None = None) -> DataFrame:
    """Rows loaded, rows kept and incidents counted in them, from one pass; ``rows``: a column of source row counts."""
    return loaded.agg(*_stage_sums(study, region, rows))


def _stage_sums(study: Study, region: str, rows: str | None) -> list[Column]:
    n = F.col(rows) if rows else F.lit(1)
    kept = kept_rows(study, region)
    return [total(F.when(kept, n)).alias("kept"), total(F.when(kept, F.col(study.incidents.count))).alias("counted"), total(n).alias("loaded")]


def _null_sums(study: Study) -> list[Column]:
    """Merged rows, and nulls in them as supply was joined, after it was filled, and after population was joined."""
    sums = [F.count(F.lit(1)).alias("rows")]
    sums += [F.count_if(F.coalesce(F.col(f"_open_{m}"), F.lit(True))).alias(f"joined_{m}") for m in study.measures]
    sums += [F.count_if(F.col(m).isNull()).alias(f"filled_{m}") for m in study.measures]
    return [*sums, F.count_if(F.col(study.total_population).isNull()).alias(f"peopled_{study.total_population}")]


@dataclass
class Checkpoints:
    """Counts that ride on the job that writes the merged table; ``row`` waits for it.

    They are what ``stage_counts`` and ``join_profile`` tell, without a job of their own. Spark adds them up as tasks end:
    a stage that runs again after a lost executor may add its rows twice, so they are for reports, not for decisions.
    """

    loaded: Observation = field(default_factory=lambda: Observation("loaded"))
    merged: Observation = field(default_factory=lambda: Observation("merged"))

    def row(self, spark: SparkSession) -> DataFrame:
        found = {**self.loaded.get, **self.merged.get}
        return spark.createDataFrame([tuple(found.values())], ", ".join(f"`{n}` long" for n in found))


def prepare_observed(
    raw: DataFrame, population: DataFrame, supply: DataFrame, study: Study, region: str, area: str, unused=(), rows: str | None = None
) -> tuple[DataFrame, Checkpoints]:
    """The merged table from incidents as loaded, and the counts that are known once it has been written."""
    c, points = study.incidents, Checkpoints()
    seen = raw.observe(points.loaded, *_stage_sums(study, region, rows))
    counts = roll_up(clean_incidents(seen, study, region, area, unused), study)
    people, quarters = unique_keys(population, [c.year, c.region]), unique_keys(supply, c.cell)
    return merge(counts, people, filled_supply(counts, quarters, study, marked=True), study, points.merged), points


def join_profile(clean: DataFrame, population: DataFrame, supply: DataFrame, study: Study) -> DataFrame:
    """Nulls in the merged rows after each step: supply joined, supply filled, population joined. One pass."""
    c = study.incidents
    counts = roll_up(clean, study)
    filled = filled_supply(counts, unique_keys(supply, c.cell), study, marked=True)
    joined = attach(attach_null_safe(counts, filled, c.cell), unique_keys(population, [c.year, c.region]), [c.year, c.region])
    return joined.agg(*_null_sums(study))
