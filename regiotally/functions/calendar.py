"""Month and quarter expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month labels in calendar order.
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def quarter_of_month(month) -> Column:
    return F.ceil(_column(month) / 3).cast("int")


def quarter_of_quarter_end(date) -> Column:
    """Quarter of a quarter-end date; any month other than 3, 6, 9 or 12 fails the job."""
    column = _column(date)
    month = F.month(column)
    message = F.concat(F.lit("not a quarter-end month: "), month.cast("string"))
    return F.when(month % 3 != 0, F.raise_error(message).cast("int")).otherwise(F.quarter(column))


def month_label(month) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_LABELS]), _column(month).cast("int"))


def period_label(year, quarter) -> Column:
    """``2024-Q1``."""
    return F.concat(_column(year).cast("string"), F.lit("-Q"), _column(quarter).cast("string"))


def month_angle(month) -> Column:
    """Position of the month on the yearly circle, in radians."""
    return F.pi() * 2 * _column(month) / 12


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
