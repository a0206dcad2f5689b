"""Standardising with the population deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from regiotally.operators.linear import Moments


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature is only centred."""

    centre: dict[str, float]
    spread: dict[str, float]
    rows: int

    def column(self, name: str) -> Column:
        return (F.col(f"`{name}`").cast("double") - self.centre[name]) / self.spread[name]

    def refined(self, moments: Moments, features) -> tuple["Scaler", Moments]:
        """The scaler of the rows behind ``moments``, which this scaler had scaled, and their moments under it."""
        mean, spread = moments.x / moments.n, moments.spread()
        centre = {f: self.centre[f] + self.spread[f] * float(m) for f, m in zip(features, mean)}
        width = {f: self.spread[f] * float(s) for f, s in zip(features, spread)}
        return Scaler(centre, width, int(moments.n)), moments.scaled(mean, spread)

    def apply(self, df: DataFrame, features, prefix: str = "z_") -> DataFrame:
        return df.withColumns({f"{prefix}{f}": self.column(f) for f in features})


def fit_scaler(df: DataFrame, features) -> Scaler:
    """One aggregate over the training rows; two numbers per feature reach the driver."""
    sums = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(features):
        value = F.col(f"`{f}`").cast("double")
        sums += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
        sums.append((F.max(value) == F.min(value)).alias(f"flat{i}"))
    row = df.agg(*sums).first()
    centre = {f: row[f"m{i}"] for i, f in enumerate(features)}
    spread = {f: 1.0 if row[f"flat{i}"] or not row[f"s{i}"] else row[f"s{i}"] for i, f in enumerate(features)}
    return Scaler(centre, spread, row["rows"])


def standardize(df: DataFrame, features, prefix: str = "z_") -> DataFrame:
    """Standardise in one lazy plan: the moments are scalar subqueries, merged by Catalyst."""
    values = {f: F.col(f"`{f}`").cast("double") for f in features}
    sums = [F.avg(v).alias(f"m_{f}") for f, v in values.items()]
    sums += [
        F.when(F.max(v) == F.min(v), F.lit(1.0)).otherwise(F.stddev_pop(v)).alias(f"s_{f}") for f, v in values.items()
    ]
    moments = df.agg(*sums)
    scaled = {}
    for f, v in values.items():
        centre = moments.select(f"`m_{f}`").scalar()
        scaled[f"{prefix}{f}"] = (v - centre) / moments.select(f"`s_{f}`").scalar()
    return df.withColumns(scaled)
