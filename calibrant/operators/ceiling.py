"""How good a forecast from the structured state alone can get."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from calibrant.functions.numbers import clipped
from calibrant.operators.boosting import Boosting, fit
from calibrant.operators.calibration import score
from calibrant.operators.pairing import long_forecasts

# The state features of the boosted-tree forecaster.
FEATURE_COLUMNS = [
    "score_differential", "game_seconds_remaining", "spread_line", "down", "ydstogo",
    "yardline_100", "qtr",
]


def boosted_forecast(
    train: DataFrame, rows: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
    outcome: str = "outcome", settings: Boosting = Boosting(), name: str = "boosted",
    cuts: Mapping[str, Sequence[float]] | None = None,
) -> DataFrame:
    """``rows`` with the probability of gradient-boosted trees trained on ``train``.

    Missing features take the side that each split gives them.
    """
    return rows.withColumn(name, fit(train, features, outcome, settings, cuts).probability())


def ceiling_table(
    rows: DataFrame, forecasts: dict[str, Column], outcome: str = "outcome", rule: str = "edges",
    split: str = "split",
) -> DataFrame:
    """Brier score and ECE of forecast columns on the same rows per split, clipped to [0, 1]."""
    stacked = long_forecasts(
        rows, {name: clipped(c) for name, c in forecasts.items()}, [split, outcome])
    return score(stacked, ["n", "brier", "ece"], [split, "variant"], outcome=outcome, rule=rule)
