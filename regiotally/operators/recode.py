"""Recoding of keys and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regiotally.operators.reshape import unique_keys


def lookup(name, mapping: dict) -> Column:
    """Value of a small literal dictionary; null for an unknown or null key."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.create_map(*pairs)[_column(name)]


def lookup_or_self(name, mapping: dict) -> Column:
    return F.coalesce(lookup(name, mapping), _column(name))


def lookup_strict(name, mapping: dict, kind: str = "int") -> Column:
    """Like ``lookup``, but a value outside the dictionary fails the job."""
    column = _column(name)
    found = lookup(column, mapping)
    message = F.concat(F.lit("value outside the recode table: "), F.coalesce(column.cast("string"), F.lit("null")))
    return F.when(found.isNull(), F.raise_error(message).cast(kind)).otherwise(found.cast(kind))


def region_from_area(region, area, balance: str, areas: dict, regions: dict, fallback: str) -> Column:
    """Two-level recode.

    Rows of the ``balance`` region are placed by their sub-area, with ``fallback`` for an unknown or
    missing one. All others are renamed by ``regions``, and a region it does not list keeps its name.
    """
    region = _column(region)
    by_area = F.coalesce(lookup(area, areas), F.lit(fallback))
    return F.when(region.eqNullSafe(F.lit(balance)), by_area).otherwise(lookup_or_self(region, regions))


def recode_by_table(df: DataFrame, name: str, table: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """Recode through a table that is unique on ``key``; unknown keys give null.

    The table may be of any size: Catalyst broadcasts it below its threshold and sorts beyond it.
    """
    dimension = table.select(F.col(key).alias(name), F.col(value).alias(alias))
    return df.join(dimension, name, "left")


def recode_pairs(df: DataFrame, first: str, second: str, table: DataFrame, alias: str, how: str = "match") -> DataFrame:
    """Recode of two columns through ``table`` (``first, second, value``), with how each row was matched.

    A row takes the value of its pair (``how`` is ``pair``); else that of its first column alone, which the table lists
    with a null second one (``first``); else it keeps its first column (``none``). The table may be of any size; two
    rows for a pair fail the job. Rows with a null first column match nothing, those with a null second one only by the
    first.
    """
    pairs = unique_keys(table.filter("first is not null and second is not null"), ["first", "second"])
    alone = unique_keys(table.filter("first is not null and second is null").select("first", "value"), ["first"])
    exact = pairs.select(F.col("first").alias("_first"), F.col("second").alias("_second"), F.struct("value").alias("_pair"))
    wide = alone.select(F.col("first").alias("_only"), F.struct("value").alias("_alone"))
    joined = df.join(exact, (F.col(first) == F.col("_first")) & (F.col(second) == F.col("_second")), "left").join(wide, F.col(first) == F.col("_only"), "left")
    found = F.when(F.col("_pair").isNotNull(), "pair").when(F.col("_alone").isNotNull(), "first").otherwise("none")
    value = F.when(F.col("_pair").isNotNull(), F.col("_pair.value")).when(F.col("_alone").isNotNull(), F.col("_alone.value"))
    named = joined.withColumns({alias: value.otherwise(F.col(first)), how: found})
    return named.drop("_first", "_second", "_pair", "_only", "_alone")


def unmapped(recoded: DataFrame, first: str, second: str, how: str = "match") -> DataFrame:
    """Pairs of values that ``recode_pairs`` found in no table, and their rows."""
    return recoded.filter(F.col(how) == "none").groupBy(first, second).agg(F.count(F.lit(1)).alias("rows"))


def drop_unmapped(df: DataFrame, name: str, mapping: dict) -> DataFrame:
    """Lenient recode in place: rows whose value is not in the dictionary leave the table."""
    return df.withColumn(name, lookup(name, mapping)).filter(F.col(name).isNotNull())


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
