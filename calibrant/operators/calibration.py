"""Scores and calibration from one table of sufficient statistics.

``bin_stats`` reads the predictions once and keeps, per group and bin, sums that add up across
partitions, batches and days. Every metric is a second, tiny aggregation of that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.numbers import clipped, nan_to_null
from calibrant.functions.scoring import LOG_EPSILON, calibration_bin
from calibrant.operators.cleaning import demanded

STATS = ["n", "sum_p", "sum_y", "sum_sq", "sum_log", "n_correct"]


def bin_stats(
    df: DataFrame,
    by: Sequence[str] = ("variant",),
    prob: str = "prob",
    outcome: str = "outcome",
    n_bins: int = 10,
    rule: str = "edges",
    threshold: float = 0.5,
    beside: dict[str, Column] | None = None,
) -> DataFrame:
    """Per group and bin: n, sums of p, y, (p-y)^2 and log score, and the correct calls.

    ``beside`` adds aggregates of your own. Rows without a probability then stay, in a bin NULL with
    n 0, so that shares of all rows come out of the same pass. NaN is no probability; one outside
    [0, 1], or an outcome that is not 0 or 1, is an error.
    """
    p, y = nan_to_null(F.col(prob).cast("double")), F.col(outcome).cast("double")
    legal = F.coalesce(p.between(0, 1), F.lit(True)) & F.coalesce(y.isin(0.0, 1.0), F.lit(True))
    df = demanded(df, legal, "probabilities must lie in [0, 1] and outcomes must be 0 or 1")
    known = p.isNotNull() & y.isNotNull()
    if beside:
        p, y = F.when(known, p), F.when(known, y)
    q = clipped(p, LOG_EPSILON, 1 - LOG_EPSILON)
    scored = df if beside else df.where(known)
    return scored.groupBy(*by, calibration_bin(p, n_bins, rule).alias("bin")).agg(
        F.count(p).alias("n"),
        F.sum(p).alias("sum_p"),
        F.sum(y).alias("sum_y"),
        F.sum((p - y) * (p - y)).alias("sum_sq"),
        F.sum(y * F.ln(q) + (1 - y) * F.ln(1 - q)).alias("sum_log"),
        F.count_if((p > threshold) == (y == 1)).alias("n_correct"),
        *[column.alias(name) for name, column in (beside or {}).items()],
    )


def merge_stats(stats: DataFrame, by: Sequence[str] = ("variant",)) -> DataFrame:
    """Add up statistics that come in pieces."""
    return stats.groupBy(*by, "bin").agg(*[F.sum(s).alias(s) for s in STATS])


def metric_columns() -> dict[str, Column]:
    """Every metric as an aggregate over the bins of one group."""
    # A group or bin without scored rows has NULL metrics.
    n, total = F.nullif(F.col("n"), F.lit(0)), F.nullif(F.sum("n"), F.lit(0))
    gap = F.abs(F.col("sum_p") - F.col("sum_y"))
    base = F.sum("sum_y") / total
    reliability = F.sum(gap * gap / n) / total
    resolution = F.sum(F.col("sum_y") * F.col("sum_y") / n) / total - base * base
    uncertainty = base * (1 - base)
    return {
        "n": F.sum("n"),
        "brier": F.sum("sum_sq") / total,
        "log_loss": -F.sum("sum_log") / total,
        "accuracy": F.sum("n_correct") / total,
        "ece": F.sum(gap) / total,
        "mce": F.max(gap / n),
        "reliability": reliability,
        "resolution": resolution,
        "uncertainty": uncertainty,
        "brier_check": reliability - resolution + uncertainty,
        "mean_prob": F.sum("sum_p") / total,
        "base_rate": base,
    }


BLOCK = ["n", "brier", "log_loss", "accuracy", "ece", "mce",
         "reliability", "resolution", "uncertainty", "brier_check"]


def metrics_from_stats(
    stats: DataFrame, by: Sequence[str] = ("variant",), metrics: Sequence[str] = BLOCK
) -> DataFrame:
    columns = metric_columns()
    return stats.groupBy(*by).agg(*[columns[m].alias(m) for m in metrics])


def score(
    df: DataFrame, metrics: Sequence[str] = BLOCK, by: Sequence[str] = ("variant",), **options
) -> DataFrame:
    """Chosen metrics of predictions in long form."""
    return metrics_from_stats(bin_stats(df, by, **options), by, metrics)


def curve_from_stats(
    stats: DataFrame, by: Sequence[str] = ("variant",), n_bins: int = 10
) -> DataFrame:
    """One row per group and bin with mean probability, mean outcome and count.

    Empty bins are there too, with count 0 and NULL means. At most ``n_bins`` entries are gathered
    per group, then laid out again.
    """
    entry = F.struct("bin", "n", "sum_p", "sum_y")
    cells = F.map_from_entries(F.collect_list(F.struct("bin", entry)))
    laid_out = stats.groupBy(*by).agg(cells.alias("cells")).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    cell = F.try_element_at("cells", F.col("bin"))
    return laid_out.select(
        *by,
        "bin",
        (cell["sum_p"] / cell["n"]).alias("confidence"),
        (cell["sum_y"] / cell["n"]).alias("accuracy"),
        F.coalesce(cell["n"], F.lit(0)).alias("n"),
    )


def reliability_curve(
    df: DataFrame, by: Sequence[str] = ("variant",), n_bins: int = 10, **options
) -> DataFrame:
    return curve_from_stats(bin_stats(df, by, n_bins=n_bins, **options), by, n_bins)


def metrics_block(
    df: DataFrame, by: Sequence[str] = ("variant",), n_bins: int = 10,
    intervals: DataFrame | None = None, **options,
) -> DataFrame:
    """One row per group: scores, Murphy terms and the curve as arrays, rounded to 4 digits.

    ``intervals`` adds bootstrap intervals, joined on the group.
    """
    by = list(by)
    stats = bin_stats(df, by, n_bins=n_bins, **options)
    columns = metric_columns()
    positions = F.sequence(F.lit(0), F.lit(n_bins - 1))
    cells = F.map_from_entries(
        F.collect_list(F.struct("bin", F.struct("n", "sum_p", "sum_y"))))
    grouped = stats.groupBy(*by).agg(
        *[columns[m].alias(m) for m in BLOCK], cells.alias("_cells"))

    def laid_out(pick):
        return F.transform(positions, lambda b: pick(F.try_element_at("_cells", b)))

    curve = F.struct(
        laid_out(lambda c: F.round(c["sum_p"] / c["n"], 4)).alias("bin_confidence"),
        laid_out(lambda c: F.round(c["sum_y"] / c["n"], 4)).alias("bin_accuracy"),
        laid_out(lambda c: F.coalesce(c["n"], F.lit(0))).alias("bin_count"),
    )
    murphy = F.struct("reliability", "resolution", "uncertainty", "brier_check")
    block = grouped.select(
        *by, "n", "brier", "log_loss", "accuracy", "ece", "mce",
        murphy.alias("murphy"), curve.alias("reliability_curve"))
    if intervals is None:
        return block
    bounds = intervals.drop(*[c for c in block.columns if c not in by])
    return block.join(bounds, by, "left")


def coverage_report(df: DataFrame, by: Sequence[str] = ("variant",)) -> DataFrame:
    """Shares of clean, parsed, truncated and in-range predictions, and the mean answer length."""
    parsed = F.col("prob").isNotNull()
    cut_off = F.coalesce("truncated", F.lit(False))

    def share(flag: Column) -> Column:
        return F.avg(flag.cast("double"))

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        share(parsed & ~cut_off).alias("coverage"),
        share(parsed).alias("parse_rate"),
        share(cut_off).alias("truncation"),
        share(F.coalesce(F.col("prob").between(0, 1), F.lit(False))).alias("in_range"),
        F.avg(F.col("chars").cast("double")).alias("mean_completion_chars"),
    )


def leaderboard(
    results: DataFrame, metric: str = "brier", ladder: Sequence[str] | None = None
) -> DataFrame:
    """Result rows, one per variant, in ladder order or from the worst score down."""
    if ladder:
        place = F.array_position(F.array(*[F.lit(v) for v in ladder]), F.col("variant"))
        last = F.when(place == 0, len(ladder) + 1).otherwise(place)
        return results.withColumn("place", last).orderBy("place", "variant")
    return results.orderBy(F.desc(metric), "variant")


def best_checkpoint(results: DataFrame, metric: str = "brier") -> DataFrame:
    """The variant with the lowest score; one without a score cannot be it."""
    scored = results.where(nan_to_null(F.col(metric).cast("double")).isNotNull())
    return scored.agg(
        F.min_by("variant", F.struct(metric, "variant")).alias("variant"),
        F.min(metric).alias(metric),
    )
