"""Rounding, rates and threshold labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(value, digits: int = 0) -> Column:
    """Round the binary double half to even; ``round`` and ``bround`` work on the decimal text.

    Adding zero makes a negative zero a plain one.
    """
    column = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.rint(column.cast("double") * scale) / scale + 0.0


def mean_of_rounded(value, digits: int) -> Column:
    """Mean of values that are already rounded to ``digits``.

    They are summed as whole units, so the mean does not depend on the order of the rows, and a mean that
    lies half-way between two roundings is seen as such.
    """
    column = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.try_divide(F.sum(F.rint(column * scale).cast("long")), F.count(column)) / scale


def rate_per(count, population, per: int = 100_000) -> Column:
    """Occurrences per ``per`` heads; null when the population is 0 or null."""
    return F.try_divide(_column(count).cast("double"), _column(population)) * float(per)


def share_pct(part, whole) -> Column:
    """Share of a whole in percent; null when the whole is 0 or null."""
    return F.try_divide(_column(part).cast("double"), _column(whole)) * 100.0


def per_head(amount, population) -> Column:
    return F.try_divide(_column(amount).cast("double"), _column(population))


def band_label(value, bands, otherwise: str) -> Column:
    """Label of the first band whose limit ``value`` exceeds, as ``[(limit, label), ...]``."""
    column = _column(value)
    chosen = F.lit(otherwise)
    for limit, label in reversed(list(bands)):
        chosen = F.when(column > limit, F.lit(label)).otherwise(chosen)
    return chosen


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
