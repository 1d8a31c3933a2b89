"""Calibration of a prediction stream in tumbling windows.

A row that is no legal prediction does not end the stream: it is left out of the statistics and kept,
as it came and with how often it came, in the same batch and table as the statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calibrant.functions.numbers import nan_to_null
from calibrant.operators.calibration import BLOCK, bin_stats, metrics_from_stats
from calibrant.streaming.table import BATCH, BatchTable

REFUSED = "refused"
_WINDOW = ["window_start", "window_end"]


def legal_prediction(prob: str = "prob", outcome: str = "outcome") -> Column:
    """Whether a row may be scored: probability in [0, 1] and outcome 0 or 1, or not known."""
    p, y = nan_to_null(F.col(prob).cast("double")), F.col(outcome).cast("double")
    return F.coalesce(p.between(0, 1), F.lit(True)) & F.coalesce(y.isin(0.0, 1.0), F.lit(True))


def stream_stats(
    stream: DataFrame, window: str = "1 day", lateness: str = "1 hour", ts: str = "ts",
    by: Sequence[str] = ("variant",), prob: str = "prob", outcome: str = "outcome", **options,
) -> DataFrame:
    """Sufficient statistics per window, group and bin, and the refused rows.

    A refused row comes as a line of its own with the row as JSON in ``refused`` and the number of
    times it came in ``rows``; its statistics are empty. Rows later than the watermark are dropped,
    and rows without a time are in no window. State is one row per open window, group and bin, and
    one per distinct refused row of an open window.
    """
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns]))
    good = legal_prediction(prob, outcome)
    windowed = stream.withWatermark(ts, lateness).withColumns({
        "_w": F.window(ts, window), REFUSED: F.when(~good, whole)})
    windowed = windowed.withColumns({
        prob: F.when(F.col(REFUSED).isNull(), F.col(prob)),
        outcome: F.when(F.col(REFUSED).isNull(), F.col(outcome))})
    stats = bin_stats(windowed, ["_w", *by, REFUSED], prob, outcome, beside={"rows": F.count(F.lit(1))}, **options)
    return stats.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        *by, "bin", "n", "sum_p", "sum_y", "sum_sq", "sum_log", "n_correct", REFUSED, "rows")


def start_monitor(
    stats: DataFrame, path: str, checkpoint: str, available_now: bool = True,
    by: Sequence[str] = ("variant",), merge_every: int = 16,
) -> StreamingQuery:
    """Write the statistics of every window that changed, also of windows still open."""
    table = BatchTable(stats.sparkSession, path, _keys(by), merge_every)
    writer = stats.writeStream.outputMode("update").foreachBatch(table.commit).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _keys(by: Sequence[str]) -> list[str]:
    return [*_WINDOW, *by, "bin", REFUSED]


def _read(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    table = BatchTable(spark, path, _keys(by)).read()
    if table is None:
        raise ValueError(f"no batch has been written to {path}")
    return table


def latest_stats(
    spark: SparkSession, path: str, by: Sequence[str] = ("variant",)
) -> DataFrame:
    """The newest statistics of every window, group and bin of the monitor's table."""
    return _read(spark, path, by).where(F.col(REFUSED).isNull() & F.col("bin").isNotNull()).drop(
        REFUSED, "rows", BATCH)


def refused_rows(
    spark: SparkSession, path: str, by: Sequence[str] = ("variant",)
) -> DataFrame:
    """Window, group, the refused row as JSON, and how often it came."""
    return _read(spark, path, by).where(F.col(REFUSED).isNotNull()).select(*_WINDOW, *by, REFUSED, "rows")


def monitor_metrics(
    stats: DataFrame, by: Sequence[str] = ("variant",), metrics: Sequence[str] = BLOCK
) -> DataFrame:
    """Scores per window and group from emitted statistics."""
    return metrics_from_stats(stats, [*_WINDOW, *by], metrics)
