"""Dummy columns whose levels are found on one table and used on others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from regiotally.operators.reshape import levels_of, listed


@dataclass(frozen=True)
class Encoder:
    """Levels of a category as found by ``fit_encoder``: plain values that can be stored beside a model."""

    column: str
    levels: tuple
    reference: object
    prefix: str

    @property
    def names(self) -> list[str]:
        """Columns that ``apply`` adds, in order."""
        return [f"{self.prefix}{v}" for v in self.levels if v != self.reference]

    def apply(self, df: DataFrame, unknown: str | None = None) -> DataFrame:
        """One boolean per level but the reference; a null category is false everywhere.

        A level that was not there to be found fails the job, or is told by a boolean column of the name ``unknown``;
        its other flags are then false.
        """
        value = F.col(self.column) if unknown else listed(self.column, self.levels)
        flags = {n: value.eqNullSafe(F.lit(v)) for n, v in zip(self.names, [v for v in self.levels if v != self.reference])}
        if unknown:
            flags[unknown] = value.isNotNull() & ~value.isin(*self.levels) if self.levels else value.isNotNull()
        return df.withColumns(flags)


def fit_encoder(train: DataFrame, column: str, prefix: str, reference=None, most: int = 1_000) -> Encoder:
    """The levels of ``column`` in ``train``, sorted; the first one is the reference unless another is named.

    More than ``most`` levels fail, as does a reference that is none of them.
    """
    levels = levels_of(train, column, most)
    if reference is not None and reference not in levels:
        raise ValueError(f"{column} has no level {reference}")
    return Encoder(column, levels, levels[0] if reference is None and levels else reference, prefix)
