"""Expanding-window validation and tuning from one pass over the rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame

from regiotally.operators.linear import Moments, fit_moments, moments_by
from regiotally.operators.position import fold_block, with_position
from regiotally.operators.scaling import Scaler


def placed_moments(
    panel: DataFrame, features, target: str, order, scaler: Scaler, part: str, folds: int = 5
) -> dict[tuple, Moments]:
    """Moments per fold block and value of ``part``: all that comparison, tuning and validation need.

    ``scaler`` only has to bring the features to a common order of
    magnitude; exact standardising follows on the moments.
    """
    placed, rows = with_position(scaler.apply(panel, features), order, "_position")
    blocks = placed.withColumn("_block", fold_block("_position", rows, folds))
    return moments_by(blocks, features, target, ["_block", part])


def combined(moments) -> Moments:
    return reduce(lambda a, b: a + b, moments)


def fold_blocks(moments: dict[tuple, Moments], places: list[int]) -> dict[int, Moments]:
    """Moments per block for some features, standardised over all rows."""
    chosen = {key: m.only(places) for key, m in moments.items()}
    whole = combined(chosen.values())
    centre, spread = whole.x / whole.n, whole.spread()
    numbers = sorted({block for block, _ in chosen})
    return {b: combined(m for (n, _), m in chosen.items() if n == b).scaled(centre, spread) for b in numbers}


def fold_errors(blocks: dict[int, Moments], kind: str, alpha: float = 0.0, scale: str = "global") -> list[float]:
    """RMSE of every fold: train on the blocks before it, test on its own.

    ``scale="global"`` keeps the features standardised over all rows; ``"per_fold"`` standardises them
    again with what the training blocks know.
    """
    errors = []
    for k in range(1, max(blocks) + 1):
        train, test = combined(blocks[i] for i in range(k)), blocks[k]
        if scale == "per_fold":
            centre, spread = train.x / train.n, train.spread()
            train, test = train.scaled(centre, spread), test.scaled(centre, spread)
        weights, intercept = fit_moments(train, kind, alpha)
        errors.append(float(np.sqrt(test.mean_squared_error(weights, intercept))))
    return errors


def mean_error(blocks: dict[int, Moments], kind: str, alpha: float = 0.0, scale: str = "global") -> float:
    return float(np.mean(fold_errors(blocks, kind, alpha, scale)))


def best_alpha(errors: dict[float, float]) -> float:
    """The alpha with the smallest error, the first listed on ties."""
    return min(errors, key=errors.get)
