"""Label clean-up on values and on column names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def without_code(label) -> Column:
    """``02 Assault`` becomes ``Assault``: everything after the first blank."""
    return F.try_element_at(F.split(_column(label), " ", 2), F.lit(2))


def before_colon(label) -> Column:
    return F.substring_index(_column(label), ":", 1)


def age_column(level: str) -> str:
    """Column name of an age group: ``10-14`` gives ``Pop_age_1014``, ``85+`` gives ``Pop_age_85plus``."""
    return "Pop_age_" + level.replace("-", "").replace("+", "plus")


def thousands(value) -> Column:
    """Whole number with thousands separators, for report views."""
    return F.format_number(_column(value), 0)


def fixed(value, digits: int) -> Column:
    """Number with a fixed count of decimals, for report views."""
    return F.format_string(f"%.{digits}f", _column(value).cast("double"))


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
