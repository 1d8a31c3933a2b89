"""Line-JSON record files and their splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrant.operators.cleaning import leak_guard
from calibrant.operators.rates import RateKey, Target, longest_prefixes


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records with a given schema; a line that is not valid JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_split_jsonl(df: DataFrame, path: str, split: str = "split") -> None:
    """Records routed to one folder per split; a training record whose prompt leaks is an error."""
    _guarded(df).write.option("ignoreNullFields", "false").partitionBy(split).json(path)


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    _guarded(df).write.option("ignoreNullFields", "false").json(path, compression=compression)


def _guarded(df: DataFrame) -> DataFrame:
    """Every record with a prompt and a hidden market price is checked as it is written."""
    return leak_guard(df) if {"prompt", "vegas_wp"} <= set(df.columns) else df


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("records"))


def attach_targets(
    rows: DataFrame, tables: Sequence[tuple[str, DataFrame, Sequence[RateKey]]],
    decimals: int | None = 5,
) -> DataFrame:
    """Rows with one target column per ``(name, rate table, keys)``, all looked up together."""
    targets = [Target(*table) for table in tables]
    return longest_prefixes(rows, targets, decimals).drop(*[f"{t.name}_level" for t in targets])


def rewrite_with_targets(
    rows: DataFrame, tables: Sequence[tuple[str, DataFrame, Sequence[RateKey]]], path: str
) -> None:
    """Split records with targets, to a new folder: a table is never written over its own input."""
    write_split_jsonl(attach_targets(rows, tables), path)
