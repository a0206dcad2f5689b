"""Appending tables and attaching dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from regiotally.operators.reshape import listed


def append(frames) -> DataFrame:
    """Stack tables by column name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def attach(facts: DataFrame, dimension: DataFrame, keys) -> DataFrame:
    """Left join to a dimension that is unique on ``keys``; ``unique_keys`` checks that inside an aggregate.

    No broadcast hint: the planner broadcasts a dimension that it knows to be small, adaptive execution
    one that turns out small, and beyond that it sorts and splits hot keys.
    """
    return facts.join(dimension, list(keys), "left")


def attach_null_safe(facts: DataFrame, dimension: DataFrame, keys) -> DataFrame:
    """Left join in which null keys meet null keys.

    No row of the dimension can be ruled out for a null key, so the planner adds no filter on that side: a dimension
    that was aggregated from ``facts`` then reads the same shuffle as ``facts`` in place of scanning once more.
    """
    named = {k: f"_key_{k}" for k in keys}
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in named.items()])
    return facts.join(dimension.withColumnsRenamed(named), same, "left").drop(*named.values())


def one_hot(df: DataFrame, column: str, levels, reference: str, prefix: str) -> DataFrame:
    """One boolean per declared level but the reference; a null category is false everywhere.

    A level that is not declared fails the job: without a flag of its own it would pass for the reference.
    """
    value = listed(column, [*levels, reference])
    flags = {f"{prefix}{v}": value.eqNullSafe(F.lit(v)) for v in levels if v != reference}
    return df.withColumns(flags)
