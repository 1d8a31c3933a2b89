"""Row filters and input checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.numbers import fixed_text, nan_to_null
from calibrant.operators.staging import computed_once
from calibrant.schemas import PLAY_REQUIRED


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column; done once, when data comes in."""
    floating = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: nan_to_null(F.col(n)) for n in floating})


def clean_plays(df: DataFrame, required: Sequence[str] = PLAY_REQUIRED) -> DataFrame:
    """Rows with every required column known."""
    return df.dropna(subset=list(required))


def kept_ratio(df: DataFrame, required: Sequence[str] = PLAY_REQUIRED) -> DataFrame:
    """One row: how many rows ``clean_plays`` keeps, of how many, and the share."""
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    return df.agg(
        F.count_if(complete).alias("kept"), F.count(F.lit(1)).alias("total")
    ).withColumn("share", F.col("kept") / F.greatest("total", F.lit(1)))


def score_violations(df: DataFrame, prob: str = "prob", outcome: str = "outcome") -> DataFrame:
    """One row: counts of what makes a score undefined."""
    p, y = F.col(prob), F.col(outcome)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p.isNull() | F.isnan(p)).alias("missing_prob"),
        F.count_if((p < 0) | ((p > 1) & ~F.isnan(p))).alias("prob_out_of_range"),
        F.count_if(~F.coalesce(y.isin(0, 1), F.lit(False))).alias("outcome_not_binary"),
    )


def validate_scores(
    df: DataFrame, prob: str = "prob", outcome: str = "outcome", lenient: bool = False
) -> DataFrame:
    """``df`` itself when it can be scored, else an error; an action.

    ``lenient`` lets missing probabilities pass, as the metrics skip them.
    """
    found = score_violations(df, prob, outcome).first().asDict()
    if found["n"] == 0:
        raise ValueError("empty input")
    if found["prob_out_of_range"] or (found["missing_prob"] and not lenient):
        raise ValueError(f"probabilities must lie in [0, 1]: {found}")
    if found["outcome_not_binary"]:
        raise ValueError(f"outcomes must be 0 or 1: {found}")
    return df


def clean_predictions(df: DataFrame) -> DataFrame:
    """Predictions that were parsed and not cut off; unknown whether cut off counts as not."""
    return df.where(F.col("prob").isNotNull() & ~F.coalesce("truncated", F.lit(False)))


def demanded(df: DataFrame, holds: Column, message: Column | str) -> DataFrame:
    """``df`` unchanged; reading a row for which ``holds`` is not true raises ``message``.

    The check is a filter, so no later projection or count drops it. The partition's number, which
    changes nothing, keeps the optimizer from moving it below earlier filters, to rows they take out.
    """
    message = F.lit(message) if isinstance(message, str) else message
    holds = holds & (F.spark_partition_id() >= 0)
    return df.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def leak_reason(prompt: Column, hidden: Column, forbidden: Sequence[str] = ("vegas",)) -> Column:
    """What leaks into a prompt: ``term``, ``value`` (its two-decimal text), or NULL."""
    lowered = F.lower(prompt)
    term = F.lit(False)
    for word in forbidden:
        term = term | F.contains(lowered, F.lit(word.lower()))
    value = F.coalesce(F.contains(prompt, fixed_text(hidden, 2)), F.lit(False))
    return F.when(term, "term").when(value, "value")


def leak_violations(
    df: DataFrame, prompt: str = "prompt", hidden: str = "vegas_wp",
    forbidden: Sequence[str] = ("vegas",),
) -> DataFrame:
    reason = leak_reason(F.col(prompt), F.col(hidden), forbidden)
    return computed_once(df, leak=reason).where(F.col("leak").isNotNull())


def leak_guard(
    df: DataFrame, prompt: str = "prompt", hidden: str = "vegas_wp",
    forbidden: Sequence[str] = ("vegas",),
) -> DataFrame:
    """``df`` unchanged; reading a row whose prompt leaks raises an error."""
    reason = leak_reason(F.col(prompt), F.col(hidden), forbidden)
    return demanded(df, reason.isNull(), F.concat(F.lit("leak in prompt: "), reason))


def split_overlaps(df: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups with rows in more than one split.

    The distinct (group, split) pairs are formed before the count, so a large group reaches the
    shuffle as a handful of rows.
    """
    pairs = df.groupBy(group, split).count()
    return (
        pairs.groupBy(group)
        .agg(F.count(F.lit(1)).alias("splits"), F.sum("count").alias("rows"))
        .where(F.col("splits") > 1)
    )
