"""Metrics over the steps of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_long(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("run", "step")) -> DataFrame:
    """Metric columns as ``(by..., metric, value)``."""
    lines = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
             for m in metrics]
    return results.select(*by, F.inline(F.array(*lines)))


def trajectory_series(
    points: DataFrame, anchor: Mapping[str, float] | None = None,
    anchored_runs: Sequence[str] | None = None,
) -> DataFrame:
    """Points in step order; a run without step 0 gets the shared anchor in front.

    ``anchor`` maps a metric to its value at step 0; ``anchored_runs`` limits which runs share it.
    """
    if not anchor:
        return points.orderBy("run", "metric", "step")
    values = F.create_map(*[F.lit(x) for item in anchor.items() for x in item])
    # A run has as many points as it had evaluations, so a window per run and metric is small.
    first = F.min("step").over(Window.partitionBy("run", "metric"))
    lacks = (F.col("step") == F.col("_first")) & (F.col("_first") != 0) & F.col("metric").isin(*anchor)
    if anchored_runs is not None:
        lacks = lacks & F.col("run").isin(*anchored_runs)
    own = F.struct("step", F.col("value").cast("double").alias("value"))
    front = F.struct(F.lit(0).cast(points.schema["step"].dataType).alias("step"),
                     F.try_element_at(values, F.col("metric")).cast("double").alias("value"))
    lines = F.when(lacks, F.array(front, own)).otherwise(F.array(own))
    return points.withColumn("_first", first).select(
        "run", "metric", F.inline(lines)).select(
        "run", "step", "metric", "value").orderBy("run", "metric", "step")
