"""Rewards and calibration bins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from calibrant.functions.extract import extract_probability
from calibrant.functions.numbers import clipped
from calibrant.functions.parsing import edge_bin

# Fixed value: probabilities are kept this far from 0 and 1 before a logarithm.
LOG_EPSILON = 1e-12


def calibration_bin(p: Column, n_bins: int = 10, rule: str = "edges") -> Column:
    """Equal-width bin of a probability; 1.0 belongs to the last bin.

    ``edges`` compares with the doubles of an evenly spaced grid, ``floor`` truncates ``p * n``.
    They differ where a grid edge is not the nearest double of its decimal (0.3, 0.6, 0.7 at ten).
    """
    if rule == "edges":
        inner = [float(edge) for edge in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
        return edge_bin(p, inner) if inner else F.when(p.isNotNull(), 0)
    if rule == "floor":
        return F.least(F.floor(p * n_bins).cast("int"), F.lit(n_bins - 1))
    raise ValueError(f"unknown binning rule {rule!r}")


def score_reward(
    prob: Column,
    outcome: Column,
    target: Column | None = None,
    *,
    blend: float = 1.0,
    sharpness_weight: float = 0.0,
    format_penalty: float = 0.0,
    clip: tuple[float, float] = (0.01, 0.99),
) -> Column:
    """Reward of one answer and its diagnostics; a missing probability earns the penalty.

    The answer is scored by squared distance to ``blend * target + (1 - blend) * outcome``, or to
    the outcome alone where there is no target.
    """
    checked = F.when(outcome.isin(0, 1), outcome.cast("double")).otherwise(
        F.raise_error(F.lit("outcome must be 0 or 1")).cast("double"))
    goal = checked
    if target is not None:
        goal = F.coalesce(blend * target + (1 - blend) * checked, checked)
    p = clipped(prob, *clip)
    brier = (p - goal) * (p - goal)
    sharpness = F.abs(p - 0.5)
    reward = 1 - brier
    if sharpness_weight:
        reward = reward * (1 + sharpness * sharpness_weight)
    return F.struct(
        p.alias("prob"),
        brier.alias("brier"),
        (1 - brier).alias("brier_reward"),
        sharpness.alias("sharpness"),
        p.isNotNull().alias("format_ok"),
        # The outcome is checked on unparsed rows too, so the penalty also depends on it.
        F.when(checked.isNotNull(), F.coalesce(reward, F.lit(float(format_penalty))))
        .alias("reward"),
    )


def score_reward_fn(use_soft_target: bool = True, **options) -> Callable[..., Column]:
    """A reward with its options bound: ``fn(text, outcome, target)`` gives the reward struct."""

    def reward(text: Column, outcome: Column, target: Column | None = None) -> Column:
        goal = target if use_soft_target else None
        return score_reward(extract_probability(text), outcome, goal, **options)

    return reward
