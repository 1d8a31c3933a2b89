"""Raw play-by-play tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.operators.cleaning import nan_as_null
from calibrant.schemas import PLAY_COLUMNS

FILE_ROWS = 5_000_000


def parse_seasons(spec: str) -> list[int]:
    """``"2015-2017,2020"`` as a sorted list of seasons."""
    seasons: set[int] = set()
    for part in spec.split(","):
        first, _, last = part.strip().partition("-")
        seasons.update(range(int(first), int(last or first) + 1))
    return sorted(seasons)


def season_filter(df: DataFrame, seasons: str | Iterable[int], column: str = "season") -> DataFrame:
    """Rows of the given seasons; prunes partitions when the table is partitioned by season."""
    wanted = parse_seasons(seasons) if isinstance(seasons, str) else sorted(set(seasons))
    return df.where(F.col(column).isin(*wanted))


def select_required(
    df: DataFrame, required: Sequence[str] = PLAY_COLUMNS, strict: bool = False
) -> DataFrame:
    """The required columns that exist. Absent ones raise a warning, or an error when strict."""
    missing = [name for name in required if name not in df.columns]
    if missing and strict:
        raise ValueError(f"columns absent: {missing}")
    if missing:
        warnings.warn(f"columns absent and skipped: {missing}", stacklevel=2)
    return df.select(*[name for name in required if name not in missing])


def scan_plays(
    spark: SparkSession, path: str, seasons: str | Iterable[int] | None = None,
    required: Sequence[str] = PLAY_COLUMNS, strict: bool = False,
) -> DataFrame:
    """Plays from parquet: only the required columns and seasons are read."""
    df = select_required(spark.read.parquet(path), required, strict)
    return df if seasons is None else season_filter(df, seasons)


def write_plays(df: DataFrame, path: str) -> None:
    """Plays as parquet, one folder per season, NaN stored as NULL.

    NULLs written here let later NOT NULL filters reach the scan.
    """
    nan_as_null(df).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("season").parquet(path)
