"""State features read back from a rendered prompt, and binning on fixed edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the rendered clauses look like.
SPREAD_PATTERN = r"Pregame line:\s+\w+\s+(favored|underdogs)\s+by\s+([\d.]+)"
DOWN_PATTERN = r"(\d)(?:st|nd|rd|th) and \d+"
OWN_PATTERN = r"ball at their own (\d+)"
OPPONENT_PATTERN = r"ball at the \w+ (\d+) yard line \(opponent territory\)"
LINE_PATTERN = r"Pregame line:\s*(\w+)\s+(favored by|underdogs by)\s+([\d.]+)"
PICKEM_PATTERN = r"Pregame line:\s*pick'?em"

# Bin edges of the state, seen from the side in possession.
SCORE_EDGES = (-21, -14, -10, -7, -4, -1, 0, 1, 4, 7, 10, 14, 21)
TIME_EDGES = (120, 300, 600, 900, 1800, 2700)
SPREAD_EDGES = (-10, -7, -3, -0.5, 0.5, 3, 7, 10)
FIELD_EDGES = (10, 20, 40, 60, 80)


def _found(text: Column, pattern: str, group: int, type_name: str) -> Column:
    """The group as a value, NULL when the pattern is absent."""
    return F.regexp_extract(text, pattern, group).try_cast(type_name)


def posteam_spread(prompt: Column) -> Column:
    """Points the side in possession is favoured by; 0 without a line or at pick'em."""
    points = _found(prompt, SPREAD_PATTERN, 2, "double")
    favoured = F.regexp_extract(prompt, SPREAD_PATTERN, 1) == "favored"
    return F.coalesce(F.when(favoured, points).otherwise(-points), F.lit(0.0))


def parse_yardline(prompt: Column) -> Column:
    """Yards to the opponent's goal; midfield when the text does not say."""
    return F.coalesce(
        100 - _found(prompt, OWN_PATTERN, 1, "int"),
        _found(prompt, OPPONENT_PATTERN, 1, "int"),
        F.lit(50),
    )


def parse_down(prompt: Column) -> Column:
    return F.coalesce(_found(prompt, DOWN_PATTERN, 1, "int"), F.lit(0))


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are at or below ``x``: half-open bins ``[edge, next edge)``, NULL for NULL."""
    steps = [(x >= F.lit(edge)).cast("int") for edge in edges]
    total = steps[0]
    for step in steps[1:]:
        total = total + step
    return total
