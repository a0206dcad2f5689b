"""Data checks and profile reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """Columns with nulls and how many, from one aggregate."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "nulls")
    return long.filter(F.col("nulls") > 0)


def coverage(df: DataFrame, keys, name: str = "rows") -> DataFrame:
    """Rows per key combination."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(*keys)
