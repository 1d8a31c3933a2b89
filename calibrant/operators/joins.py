"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], how: str, salt_by: str | Column,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    ``rows`` takes its salt from ``salt_by``, a column that varies inside a key; every ``lookup``
    row is repeated once per salt. ``lookup`` should have few rows per key.
    """
    column = F.col(salt_by) if isinstance(salt_by, str) else salt_by
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(column), F.lit(salts)))
    repeated = lookup.withColumn(
        "_salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")

