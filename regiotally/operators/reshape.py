"""Grouped sums, pivots and column arrangement."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from regiotally.functions.nulls import all_known, total


@dataclass(frozen=True)
class Split:
    """A category column that becomes one column per level."""

    column: str
    levels: tuple[str, ...]
    rename: Callable[[str], str] = field(default=str)


def unique_keys(df: DataFrame, keys) -> DataFrame:
    """One row per key; a second row of a key fails the job, inside the aggregate that would be needed anyway."""
    values = [c for c in df.columns if c not in keys]
    clash = F.raise_error(F.lit(f"more than one row for a key of {', '.join(keys)}"))
    once = {c: F.when(F.count(F.lit(1)) > 1, clash.cast(df.schema[c].dataType)).otherwise(F.first(c)) for c in values}
    return df.groupBy(*keys).agg(*[v.alias(c) for c, v in once.items()])


def grouped_total(df: DataFrame, keys, measures, keep_null_keys: bool = False) -> DataFrame:
    """Sums by key. Null keys form groups only with ``keep_null_keys``; an all-null group sums to 0."""
    rows = df if keep_null_keys else df.filter(all_known(keys))
    return rows.groupBy(*keys).agg(*[total(m).alias(m) for m in measures])


def listed(column: str, levels) -> Column:
    """The column itself; a level outside the list fails the job, because its rows would vanish from the columns."""
    value = F.col(column)
    text = F.concat(F.lit(f"{column} has a level that is not listed: "), value.cast("string"))
    return F.when(value.isNull() | value.isin(*levels), value).otherwise(F.raise_error(text))


def found_levels(df: DataFrame, splits) -> list[Split]:
    """Splits without declared levels get those of the data, at the price of a job."""
    return [s if s.levels else Split(s.column, levels_of(df, s.column), s.rename) for s in splits]


def totals_by_split(df: DataFrame, keys, measure: str, total_name: str, splits) -> DataFrame:
    """A total and one column per level of every split, in one aggregate. An unlisted level fails the job.

    The same as inner-joining one pivot per split: a key for which some split has only null levels
    is left out. No join and one shuffle, whatever the number of splits.
    """
    splits = found_levels(df, splits)
    df = df.withColumns({s.column: listed(s.column, s.levels) for s in splits})
    columns = [total(measure).alias(total_name)]
    seen = []
    for i, split in enumerate(splits):
        for level in split.levels:
            counted = F.when(F.col(split.column) == level, F.col(measure))
            columns.append(total(counted).alias(split.rename(level)))
        columns.append(F.max(F.col(split.column).isNotNull()).alias(f"_seen{i}"))
        seen.append(f"_seen{i}")
    wide = df.filter(all_known(keys)).groupBy(*keys).agg(*columns)
    for name in seen:
        wide = wide.filter(F.col(name))
    return wide.drop(*seen)


#: More levels than this are no category: they could not become columns either.
MOST_LEVELS = 10_000


def levels_of(df: DataFrame, column: str, most: int = MOST_LEVELS) -> tuple:
    """Distinct levels of a category, sorted; they become columns, and more than ``most`` of them fail."""
    found = tuple(r[0] for r in distinct_sorted(df, column).limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return found


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def pivot_total(df: DataFrame, keys, column: str, measure: str, levels=None, prefix: str = "") -> DataFrame:
    """Pivot of sums with 0 for absent combinations. ``levels`` of None are found in the data; others fail the job."""
    levels = levels_of(df, column) if levels is None else levels
    df = df.withColumn(column, listed(column, levels))
    columns = [
        F.coalesce(F.sum(F.when(F.col(column) == level, F.col(measure))), F.lit(0)).alias(f"{prefix}{level}")
        for level in levels
    ]
    return df.filter(all_known([*keys, column])).groupBy(*keys).agg(*columns)


def pivot_count(df: DataFrame, keys, column: str, levels=None, prefix: str = "") -> DataFrame:
    """Pivot of row counts, with levels as in ``pivot_total``."""
    levels = levels_of(df, column) if levels is None else levels
    df = df.withColumn(column, listed(column, levels))
    columns = [F.count_if(F.col(column) == level).alias(f"{prefix}{level}") for level in levels]
    return df.filter(all_known([*keys, column])).groupBy(*keys).agg(*columns)


def pivot_single(df: DataFrame, keys, column: str, measure: str, levels=None, prefix: str = "") -> DataFrame:
    """Pivot of values that occur once per cell: no filling, and a second row in a cell fails the job."""
    kind = df.schema[measure].dataType
    levels = levels_of(df, column) if levels is None else levels
    df = df.withColumn(column, listed(column, levels))
    columns = []
    for level in levels:
        here = F.col(column) == level
        clash = F.raise_error(F.lit(f"more than one row per cell of {column}"))
        value = F.max(F.when(here, F.col(measure)))
        columns.append(F.when(F.count_if(here) > 1, clash.cast(kind)).otherwise(value).alias(f"{prefix}{level}"))
    return df.groupBy(*keys).agg(*columns)


def by_listed_order(df: DataFrame, column: str, order) -> DataFrame:
    """Keep the listed levels, sorted as listed. A listed level without a row fails the job."""
    listing = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"_level {df.schema[column].dataType.simpleString()}, _place int")
    missing = F.raise_error(F.concat(F.lit(f"{column} lacks "), F.col("_level").cast("string")))
    found = listing.join(df.withColumn("_here", F.lit(True)), F.col("_level") == F.col(column), "left")
    checked = F.when(F.col("_here").isNull(), missing).otherwise(F.col(column))
    return found.withColumn(column, checked.cast(df.schema[column].dataType)).orderBy("_place").select(*df.columns)


def arranged(df: DataFrame, first, prefix: str, last) -> DataFrame:
    """Fixed leading columns, then those starting with ``prefix`` in sorted order, then the rest named."""
    return df.select(*first, *sorted(c for c in df.columns if c.startswith(prefix)), *last)
