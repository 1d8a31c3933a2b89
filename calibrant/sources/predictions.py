"""Prediction maps: JSON objects ``{variant: [prediction, ...]}``.

A table of any size is written as many such objects, one per line, each holding a bounded range of
row ids of every variant. A single object without row ids, as other tools write it, is read by
position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.operators.cleaning import demanded, nan_as_null
from calibrant.schemas import PREDICTION, PREDICTION_MAP
from calibrant.sources.large_maps import SINGLE_VARIANT, read_large_maps

RANGE_ROWS = 5_000


def parse_prediction_maps(lines: DataFrame, text: str = "value") -> DataFrame:
    """Long predictions ``(variant, row_id, ...)`` from map objects or bare arrays.

    A bare array becomes the variant ``_``. Without a stored row id the position inside the array
    is the row id; a second object of a variant without ids is an error, as its positions would
    repeat those of the first. NaN probabilities and prices are NULL.
    """
    raw = F.trim(F.col(text))
    wrapped = F.when(
        F.startswith(raw, F.lit("[")), F.concat(F.lit(f'{{"{SINGLE_VARIANT}":'), raw, F.lit("}"))
    ).otherwise(raw)
    maps = lines.where(raw != "").select(
        F.from_json(wrapped, PREDICTION_MAP, {"mode": "FAILFAST"}).alias("m"))
    arrays = maps.select(F.explode("m").alias("variant", "rows"))
    bare = F.exists("rows", lambda r: r["row_id"].isNull())
    # One row per variant: how many of its arrays go by position.
    by_position = arrays.where(bare).groupBy("variant").agg(F.count(F.lit(1)).alias("_arrays"))
    by_position = demanded(by_position, F.col("_arrays") == 1,
                           "several objects without row ids hold one variant")
    arrays = arrays.join(F.broadcast(by_position), "variant", "left")
    arrays = arrays.where(F.col("_arrays").isNull() | (F.col("_arrays") == 1))
    rows = arrays.select("variant", F.posexplode("rows").alias("pos", "r"))
    fields = [F.col(f"r.{name}").alias(name) for name in PREDICTION.fieldNames()
              if name not in ("row_id", "vegas")]
    return nan_as_null(rows.select(
        "variant", F.coalesce("r.row_id", F.col("pos").cast("bigint")).alias("row_id"),
        *fields, F.col("r.vegas").alias("market")))


def read_prediction_maps(
    spark: SparkSession, path: str, variant: str | None = None, whole_file: bool = False
) -> DataFrame:
    """Predictions from a file or folder of map lines.

    With ``whole_file`` every file holds one object, on any number of lines; a large one is read by
    many tasks.
    """
    rows = read_large_maps(spark, path) if whole_file else parse_prediction_maps(spark.read.text(path))
    if variant is None:
        return rows
    found = rows.where(F.col("variant") == variant)
    if found.isEmpty():
        raise ValueError(f"variant {variant!r} not in {path}")
    return found


def prediction_entry(**columns: Column) -> Column:
    """One map entry's prediction struct from columns given by field name."""
    return F.struct(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PREDICTION.fields])


def prediction_map_lines(preds: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One JSON map per range of ``range_rows`` row ids; no line gathers more than that."""
    c = F.col
    entry = prediction_entry(
        row_id=c("row_id"), game_id=c("game_id") if "game_id" in preds.columns else F.lit(None),
        prob=c("prob"), outcome=c("outcome"), vegas=c("market"),
        parsed=c("prob").isNotNull(), truncated=c("truncated"))
    ranged = preds.select(
        F.floor(c("row_id") / range_rows).alias("_range"), "variant", entry.alias("_entry"))
    arrays = ranged.groupBy("_range", "variant").agg(
        F.array_sort(F.collect_list("_entry")).alias("_rows"))
    maps = arrays.groupBy("_range").agg(
        F.map_from_entries(F.collect_list(F.struct("variant", "_rows"))).alias("m"))
    return maps.select(F.to_json("m", {"ignoreNullFields": "false"}).alias("value"))


def write_prediction_maps(preds: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> None:
    prediction_map_lines(preds, range_rows).write.text(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """The table form: parquet, one folder per variant."""
    preds.write.partitionBy("variant").parquet(path)
