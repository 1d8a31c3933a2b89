"""Per-step figures of a training run and of a format check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.scoring import calibration_bin
from calibrant.operators.calibration import bin_stats, metric_columns
from calibrant.operators.joins import salted_join
from calibrant.session import stored

STD_TOLERANCE = 1e-12


def _ece(p: Column, y: Column, valid: Column, n_bins: int = 10) -> Column:
    """ECE as one aggregate: per bin the sum of p - y, all bins side by side."""
    bin_ = calibration_bin(p, n_bins)
    gaps = [F.abs(F.coalesce(F.sum(F.when(bin_ == b, p - y)), F.lit(0.0))) for b in range(n_bins)]
    total = gaps[0]
    for gap in gaps[1:]:
        total = total + gap
    return F.try_divide(total, F.count_if(valid))


def reward_telemetry(
    scored: DataFrame, step: str = "step", min_valid: int = 20
) -> DataFrame:
    """Per step: format rate, answer length, reward, probability and spread.

    ``scored`` has ``reward`` structs, ``outcome`` and ``chars``. ECE needs ``min_valid`` answers.
    """
    r, y = F.col("reward"), F.col("outcome").cast("double")
    ok = r["format_ok"]
    p = F.when(ok, r["prob"])
    return scored.groupBy(step).agg(
        F.avg(ok.cast("double")).alias("format_success_rate"),
        F.avg(F.col("chars").cast("double")).alias("mean_completion_chars"),
        F.avg(F.when(ok, r["brier_reward"])).alias("mean_brier_reward"),
        F.avg(F.when(ok, r["reward"])).alias("mean_reward"),
        F.avg(p).alias("mean_predicted_prob"),
        F.avg(F.abs(p - 0.5)).alias("mean_confidence"),
        F.stddev_pop(p).alias("pred_prob_std"),
        F.when(F.count_if(ok) >= min_valid, _ece(p, y, ok)).alias("batch_ece"),
    )


def checkpoint_eval(
    preds: DataFrame, by: Sequence[str] = ("step",), min_parsed: int = 10
) -> DataFrame:
    """Held-out scores per step; steps with fewer parsed answers than ``min_parsed`` are skipped."""
    by = list(by)
    columns = metric_columns()
    parsed = F.col("prob").isNotNull()
    error = F.when(parsed, F.col("market") - F.col("outcome"))
    stats = bin_stats(preds, by, beside={
        "n_all": F.count(F.lit(1)), "sum_market": F.sum(error * error)})
    names = ["n", "brier", "ece", "reliability", "resolution", "uncertainty", "brier_check"]
    return stats.groupBy(*by).agg(
        *[columns[m].alias(m) for m in names],
        columns["mean_prob"].alias("mean_predicted_prob"),
        (F.sum("n") / F.sum("n_all")).alias("format_success"),
        F.try_divide(F.sum("sum_market"), F.sum("n")).alias("market_brier"),
    ).where(F.col("n") >= min_parsed)


def format_probe(
    answers: DataFrame, by: Sequence[str] = (), extreme: tuple[float, float] = (0.1, 0.9)
) -> DataFrame:
    """How well answers keep the format, and what their probabilities look like.

    ``answers`` has ``text, reasoning, prob, truncated``.
    """
    text, reasoning = F.coalesce("text", F.lit("")), F.coalesce("reasoning", F.lit(""))
    p = F.col("prob")
    length = F.length(text) + F.length(reasoning)
    thinks = (reasoning != "") | F.contains(F.lower(text), F.lit("<think>"))
    outside = F.when(p.isNotNull(), ((p < extreme[0]) | (p > extreme[1])).cast("double"))
    # Lengths are counted before the exact median, so it sees each distinct length once.
    lengths = answers.groupBy(*by, length.alias("_length")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(p.isNotNull()).alias("_parsed"),
        F.count_if(F.col("truncated")).alias("_truncated"),
        F.count_if(thinks).alias("_thinks"),
        F.sum(p).alias("_p"), F.count(p).cast("double").alias("_k"), F.var_pop(p).alias("_v"),
        F.min(p).alias("_min"), F.max(p).alias("_max"),
        F.sum(F.abs(p - 0.5)).alias("_confidence"),
        F.sum(outside).alias("_extreme"))
    n, parsed = F.sum("_n"), F.sum("_parsed")
    mean = F.try_divide(F.sum("_p"), parsed)
    # Spread inside the lengths plus spread of their means about one half: nothing large cancels.
    part = F.try_divide(F.col("_p"), F.col("_k")) - 0.5
    middle = F.try_divide(F.sum(F.col("_k") * part), parsed)
    variance = F.greatest(F.lit(0.0), F.try_divide(
        F.sum(F.col("_k") * (F.col("_v") + part * part)), parsed) - middle * middle)
    return lengths.groupBy(*by).agg(
        n.alias("samples"),
        (parsed / n).alias("format_success"),
        (F.sum("_truncated") / n).alias("truncated"),
        (F.sum("_thinks") / n).alias("think_present"),
        mean.alias("mean_prob"),
        F.when(parsed > 0, F.sqrt(variance)).alias("std_prob"),
        F.min("_min").alias("min_prob"), F.max("_max").alias("max_prob"),
        F.try_divide(F.sum("_confidence"), parsed).alias("mean_confidence"),
        F.try_divide(F.sum("_extreme"), parsed).alias("extreme_share"),
        F.floor(F.percentile("_length", F.lit(0.5), F.col("_n"))).cast("int").alias("median_chars"),
        F.max("_length").alias("max_chars"),
    )


def group_spread(
    rewards: DataFrame, group: str = "group_id", reward: str = "reward", min_std: float = 0.05
) -> DataFrame:
    """Per group: size, population deviation of the reward, and whether it is worth keeping.

    A deviation within rounding error of ``min_std`` counts as reaching it.
    """
    return rewards.groupBy(group).agg(
        F.count(reward).alias("n"), F.stddev_pop(reward).alias("std"),
    ).withColumn("varied", (F.col("n") > 1) & (F.col("std") >= min_std - STD_TOLERANCE))


def variance_groups(
    rewards: DataFrame, group: str = "group_id", reward: str = "reward", min_std: float = 0.05,
    row_id: str = "row_id",
) -> DataFrame:
    """Rows of the groups whose rewards vary enough.

    The rows are stored once, so what made the rewards is computed once; pass only columns needed.
    """
    held = stored(rewards, "rewards")
    kept = group_spread(held, group, reward, min_std).where("varied").select(group)
    return salted_join(held, kept, [group], "left_semi", row_id)
