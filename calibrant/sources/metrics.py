"""Metric results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from calibrant.sources.records import write_jsonl


def write_metrics(results: DataFrame, path: str, form: str = "json") -> None:
    """Result rows as line JSON with explicit nulls, or as parquet."""
    if form == "json":
        write_jsonl(results, path)
    elif form == "parquet":
        results.write.parquet(path)
    else:
        raise ValueError(f"unknown form {form!r}")
