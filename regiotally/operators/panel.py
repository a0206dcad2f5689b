"""Panel features: one row per entity and month, with lags by position or by calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from regiotally.functions.calendar import month_angle


def add_lags(df: DataFrame, entity: str, order, column: str, lags, prefix: str) -> DataFrame:
    """Values of earlier *rows* of the entity: a missing month shifts what a lag means.

    A window group holds the months of one entity, so its size is bounded by the calendar.
    """
    ordered = W.partitionBy(entity).orderBy(*order)
    return df.withColumns({f"{prefix}{k}": F.lag(column, k).over(ordered) for k in lags})


def add_season(df: DataFrame, month: str) -> DataFrame:
    angle = month_angle(month)
    return df.withColumns({"sin_month": F.sin(angle), "cos_month": F.cos(angle)})


def complete_months(df: DataFrame, entity: str, year: str, month: str) -> DataFrame:
    """Add the months an entity lacks between its first and last one, other columns null.

    With this in front, lags by position are lags by calendar.
    """
    number = F.col(year) * 12 + F.col(month) - 1
    spans = df.groupBy(entity).agg(F.min(number).alias("_from"), F.max(number).alias("_to"))
    spine = spans.select(entity, F.explode(F.sequence("_from", "_to")).alias("_number")).select(
        entity,
        F.floor(F.col("_number") / 12).cast("int").alias(year),
        (F.col("_number") % 12 + 1).cast("int").alias(month),
    )
    return spine.join(df, [entity, year, month], "left")


def split_years(df: DataFrame, train, test) -> tuple[DataFrame, DataFrame]:
    """Two filters on one table; ``train`` and ``test`` are conditions."""
    return df.filter(train), df.filter(test)
