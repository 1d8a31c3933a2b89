"""Audited rows: ``{ground_truth, models: {label: {mode, text, parsed_prob, verdict}}}`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrant.schemas import BOOLEAN_CATEGORIES, JUDGED_ROW
from calibrant.sources.records import read_jsonl, write_jsonl


def _verdict_state(verdict: Column) -> Column:
    """The verdict struct with ``parse_ok`` and ``usable``, as ``parse_verdict`` gives it."""
    names = [*BOOLEAN_CATEGORIES, "faithfulness"]
    known = F.coalesce(*[verdict[n][field].cast("string") for n in names for field in ("v", "q")])
    return F.struct(
        verdict.isNotNull().alias("parse_ok"), known.isNotNull().alias("usable"),
        *[verdict[n].alias(n) for n in names])


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """Long form ``(row_id, ground_truth, label, mode, text, parsed_prob, verdict)``."""
    rows = read_jsonl(spark, path, JUDGED_ROW)
    long = rows.select("row_id", "ground_truth", F.explode("models").alias("label", "m"))
    return long.select(
        "row_id", "ground_truth", "label", "m.mode", "m.text", "m.parsed_prob",
        _verdict_state(F.col("m.verdict")).alias("verdict"))


def write_judged(judged: DataFrame, path: str) -> None:
    """One line per item; its models are gathered into a map, so a line is as wide as the ladder.

    A map holds a label once: rows that repeat one go to further lines of the item, and so does a
    second ground truth. The lines are compressed.
    """
    v = F.col("verdict")
    stored = F.when(v["parse_ok"], F.struct(
        *[v[n].alias(n) for n in [*BOOLEAN_CATEGORIES, "faithfulness"]]))
    entry = F.struct("mode", "text", "parsed_prob", stored.alias("verdict"))
    again = Window.partitionBy("row_id", "label", "ground_truth").orderBy("label")
    rows = (
        judged.select("row_id", "ground_truth", "label", entry.alias("_entry"))
        .withColumn("_line", F.row_number().over(again)).groupBy("row_id", "ground_truth", "_line").agg(
            F.any_value("ground_truth").alias("_truth"),
            F.map_from_entries(F.collect_list(F.struct("label", "_entry"))).alias("models"))
        .select("row_id", F.col("_truth").alias("ground_truth"), "models")
    )
    write_jsonl(rows, path, "gzip")
