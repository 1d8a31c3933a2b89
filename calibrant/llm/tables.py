"""Tables that cut lineage: written once to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.session import stored


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``.

    The rows are computed once. A lost executor costs the running tasks and nothing of what is
    already written, because only the files of committed tasks belong to the table.
    """
    return stored(df, purpose)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(column: str = "doc_id") -> Column:
    """An id as text; NULL as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(id_text(column).cast("binary")) % F.lit(modulus)
