"""Filling gaps from group means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from regiotally.functions.nulls import all_known
from regiotally.functions.numeric import round_even
from regiotally.operators.combine import attach_null_safe


def fill_group_mean(df: DataFrame, columns, keys) -> DataFrame:
    """Replace nulls by the mean of the group, all columns at once.

    The means come from one aggregate with map-side combine and are joined back, so a group with a
    third of the rows never meets in one task, as it would in a window over ``keys``. A row with a null key has no
    group. Both readers of ``df`` ask for the same rows, so a shuffle below them is computed once.
    """
    means = df.groupBy(*keys).agg(*[F.when(all_known(keys), F.avg(c)).alias(f"_mean_{c}") for c in columns])
    filled = {c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in columns}
    return attach_null_safe(df, means, keys).withColumns(filled).drop(*[f"_mean_{c}" for c in columns])


def fill_weighted_mean(cells: DataFrame, columns, keys, weight: str) -> DataFrame:
    """The same fill one grain up: ``weight`` tells how many rows each cell stands for.

    A value that is constant within a cell needs no row-level pass: the row-weighted mean over all rows
    is the cell mean weighted by the row counts. A window reads the cells once; a group of it holds the few cells of
    its keys, whatever the number of rows behind them.
    """
    group, filled = W.partitionBy(*keys), {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.col(weight))
        mean = F.try_divide(F.sum(F.col(c) * F.col(weight)).over(group), F.sum(known).over(group))
        filled[c] = F.coalesce(F.col(c), F.when(all_known(keys), mean))
    return cells.withColumns(filled)


def whole_numbers(df: DataFrame, columns) -> DataFrame:
    """Round to integers; a null that is still left fails the job."""
    cast = {}
    for c in columns:
        missing = F.raise_error(F.lit(f"{c} has no value to impute from")).cast("long")
        cast[c] = F.when(F.col(c).isNull(), missing).otherwise(round_even(c).cast("long"))
    return df.withColumns(cast)
