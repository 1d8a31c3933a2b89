"""Labels, difficulty and season splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seasons held out by default; every other season trains.
EVAL_SEASONS = (2023,)
TEST_SEASONS = (2024,)


def possession_outcome(result: Column, posteam: Column, home_team: Column) -> Column:
    """1 when the side in possession won, 0 when it lost, NULL on a tie or an unknown margin.

    ``result`` is the home margin, so the sign is turned for an away possession.
    """
    possession_margin = F.when(posteam.eqNullSafe(home_team), result).otherwise(-result)
    return F.when(possession_margin > 0, 1).when(possession_margin < 0, 0)


def difficulty(p: Column) -> Column:
    """1 at an even chance, 0 at certainty."""
    return 1 - F.abs(2 * p - 1)


def season_split(
    season: Column,
    eval_seasons: Iterable[int] = EVAL_SEASONS,
    test_seasons: Iterable[int] = TEST_SEASONS,
) -> Column:
    return (
        F.when(season.isin(*eval_seasons), "eval")
        .when(season.isin(*test_seasons), "test")
        .otherwise("train")
    )
