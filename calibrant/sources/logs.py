"""Evaluation points in training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: how a point looks in a log line, ``[eval @ 50] {'eval/brier': 0.2, ...}``.
POINT_PATTERN = r"\[eval @ (\d+)\]\s+(\{.*?\})"
METRIC_PREFIX = "eval/"


def parse_log_lines(lines: DataFrame, run: str = "run", order: str = "line_order") -> DataFrame:
    """``(run, step, metric, value)`` of every point; the last point of a step counts.

    A figure that is no number has value NULL and the others of its point stay. A comma before the
    closing brace is allowed. Points that are no flat map are skipped.
    """
    steps = F.regexp_extract_all("value", F.lit(POINT_PATTERN), F.lit(1))
    figures = F.regexp_extract_all("value", F.lit(POINT_PATTERN), F.lit(2))
    # Dictionaries are printed with single quotes and None.
    as_json = F.regexp_replace(F.replace(F.col("p.figures"), F.lit("'"), F.lit('"')),
                               r"\bNone\b", "null")
    as_json = F.regexp_replace(as_json, r",\s*\}$", "}")
    points = lines.where(F.contains("value", F.lit("[eval @ "))).select(
        run, order,
        F.posexplode(F.arrays_zip(steps.alias("step"), figures.alias("figures"))).alias("nth", "p"))
    parsed = points.select(
        run, F.col("p.step").cast("int").alias("step"), F.struct(order, "nth").alias("at"),
        F.from_json(as_json, "map<string,string>").alias("figures"))
    last = parsed.where(F.col("figures").isNotNull()).groupBy(run, "step").agg(
        F.max_by("figures", "at").alias("figures"))
    return last.select(run, "step", F.explode("figures").alias("metric", "value")).withColumns({
        "metric": F.replace(F.col("metric"), F.lit(METRIC_PREFIX), F.lit("")),
        "value": F.col("value").try_cast("double")})


def log_scan(spark: SparkSession, path: str) -> DataFrame:
    """Points of every log under ``path``; a run is a ``run=...`` folder, or else a file."""
    lines = spark.read.text(path)
    if "run" not in lines.columns:
        lines = lines.withColumn("run", F.col("_metadata.file_name"))
    # Inside one split of a file the generated ids rise with the lines; splits order by offset.
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("line"))
    return parse_log_lines(lines.select("value", "run", order.alias("line_order")))
