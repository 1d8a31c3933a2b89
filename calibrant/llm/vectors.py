"""Vector columns: which rows take part, packed rows, and bounded samples to fit an index on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not NULL, not all zero, and every component a finite number; never NULL itself."""
    column = F.col(vector)
    finite = F.forall(column, lambda x: F.coalesce(
        (x == x) & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def lengths(df: DataFrame, vector: str) -> list[int]:
    """The numbers of components that vectors have, ascending. Each is a space of its own; a table
    holds as many as it holds embedding models."""
    return sorted(row.size for row in df.select(F.size(vector).alias("size")).distinct().collect())


def to_matrix(blobs: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(-1, size)


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first: the square of a component must not overflow or vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def column_matrix(column, size: int) -> np.ndarray:
    """An Arrow list column without NULLs as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def sample(rows: DataFrame, id_column: str, vector: str, size: int, most: int, seed: int) -> np.ndarray:
    """At most ``most`` vectors, those with the smallest hash of their id and components."""
    chosen = rows.select(
        vector, F.xxhash64(id_column, vector, F.lit(seed)).alias("_order")
    ).orderBy("_order").limit(most).collect()
    return np.array([row[0] for row in chosen], dtype=np.float64).reshape(-1, size)
