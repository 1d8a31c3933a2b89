"""Named queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.plans.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
DIGITS = 9
NUDGE = 1e-12


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` gives the same rows from the same tables."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits: sums differ in the last bits with the row order.

    Means of whole percents over 64 rows end exactly half-way; the nudge, which the checking SQL
    has too, settles those.
    """
    return df.select(*[
        F.round(F.col(name) + NUDGE, digits).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes])
