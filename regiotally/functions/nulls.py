"""Null rules that differ between dataframe libraries and SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def differs_or_null(name: str, value) -> Column:
    """``name <> value``, keeping the rows where ``name`` is null."""
    return ~F.col(name).eqNullSafe(F.lit(value))


def all_known(names) -> Column:
    """True where no key is null: grouping leaves null keys out unless told otherwise."""
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def first_known(value, *order) -> Column:
    """First value that is not null, by ``order``; the smaller value where the order ties.

    One mergeable aggregate: tasks send a value and its place on, and rows need no sorting. Nulls in ``order`` come first.
    """
    column = F.col(value) if isinstance(value, str) else value
    places = [F.col(o) if isinstance(o, str) else o for o in order]
    return F.min_by(column, F.when(column.isNotNull(), F.struct(*[p.alias(f"o{i}") for i, p in enumerate([*places, column])])))


def total(column) -> Column:
    """Sum that is 0, not null, when every value in the group is null."""
    summed = F.sum(column)
    return F.coalesce(summed, F.lit(0))
