"""Flags and picks on summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def flag_extreme(df: DataFrame, column: str, alias: str, smallest: bool = False) -> DataFrame:
    """Mark every row that equals the overall maximum (or minimum) of ``column``.

    The extreme is a scalar subquery, so no task sees the whole summary. ``column`` must compare
    exactly on recomputation: a count, a whole-number sum or a rounded value.
    """
    pick = F.min if smallest else F.max
    return df.withColumn(alias, F.col(column) == df.agg(pick(column)).scalar())


def first_by(df: DataFrame, *order) -> DataFrame:
    """The row that comes first; with keys at the end of ``order`` ties are settled."""
    return df.orderBy(*order).limit(1)


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def by_magnitude(df: DataFrame, column: str, *ties) -> DataFrame:
    return df.orderBy(F.abs(column).desc(), *ties)
