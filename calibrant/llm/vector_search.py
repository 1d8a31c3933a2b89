"""Nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are scaled to length one, rotated by a random orthogonal matrix and dealt to the list of
their nearest centroid. A query scans the lists of its ``probes`` nearest centroids. In a list the
rotated components stand in blocks of columns; after each block the squared distance so far, scaled
up to all dimensions, is tested against the query's fifth-best distance. Because of the rotation the
scaled partial distance is close to the whole one, so a candidate that lies above by more than the
allowance for the number of dimensions seen is abandoned. What is left is scored exactly, in
double precision on the original vectors.

Centroids are fitted on a bounded sample (``sample``); every row is indexed. ``probes`` is the
smallest number that reaches ``recall`` on a part of the sample, measured against brute force.
Lists and their queries are dealt out in blocks, so one list may hold a third of all rows.

Vectors are neighbours of vectors of their own length; every length has an index of its own. Rows
whose vector or id is NULL, whose vector is zero or has other components than finite numbers take no
part. A repeated query id is one query, with its smallest vector; rows with the id of a query are no
candidates for it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrant.llm.tables import shuffle_width, written
from calibrant.llm.vectors import column_matrix, lengths, sample, unit, usable


@dataclass(frozen=True)
class Search:
    """Parameters of the index and the search."""

    nearest: int = 5
    list_rows: int = 200       # a list for about this many rows ...
    most_lists: int = 4096     # ... and no more lists than this
    sample: int = 20_000
    rounds: int = 8
    recall: float = 0.97
    block: int = 16            # dimensions per column block
    allowance: float = 2.1
    rows_block: int = 8192
    queries_block: int = 2048
    seed: int = 8


@dataclass(frozen=True)
class Index:
    size: int
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int


def fit(points: np.ndarray, rows: int, search: Search) -> Index:
    """Spherical k-means, a rotation, and the number of lists to probe."""
    draw = np.random.default_rng(search.seed)
    size = points.shape[1]
    rotation, r = np.linalg.qr(draw.normal(size=(size, size)))
    rotation = rotation * np.sign(np.diag(r))
    points = unit(points)
    lists = min(search.most_lists, 1 + rows // search.list_rows, len(points))
    centroids = points[draw.choice(len(points), lists, replace=False)]
    for _ in range(search.rounds):
        nearest = _nearest_lists(points, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1)
        # An empty list keeps its centroid.
        centroids = np.where((length > 1e-9)[:, None], sums / np.maximum(length, 1e-9)[:, None],
                             centroids)
    asked = points[draw.choice(len(points), min(400, len(points)), replace=False)]
    # The first is the query itself.
    close = np.argsort(-(asked @ points.T), axis=1)[:, 1:search.nearest + 1]
    home = _nearest_lists(points, centroids, 1)[:, 0][close]
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, home, axis=1).reshape(-1)) + 1
    probes = int(needed[int(np.ceil(search.recall * len(needed))) - 1]) if len(needed) else lists
    return Index(size, centroids, rotation, probes)


def _nearest_lists(points: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centroids, in no order; a block of points at a time."""
    out = []
    for begin in range(0, len(points), 4096):
        near = points[begin:begin + 4096] @ centroids.T
        n = min(n, near.shape[1])
        out.append(np.argpartition(-near, n - 1, axis=1)[:, :n])
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


def scan(
    index: Index, search: Search, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray,
    row_ids: np.ndarray,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its nearest rows of one block: query ids, row ids and scores."""
    asked, points = unit(queries), unit(rows)
    turned = (points @ index.rotation).astype(np.float32)
    turned_asked = (asked @ index.rotation).astype(np.float32)
    size, k = index.size, search.nearest
    columns = [np.ascontiguousarray(turned[:, b:b + search.block].T)
               for b in range(0, size, search.block)]
    first = min(len(points), max(64, 4 * k))
    for number in range(len(asked)):
        other = row_ids != query_ids[number]
        start = np.flatnonzero(other[:first])
        gap = turned[start] - turned_asked[number]
        found = np.sort((gap * gap).sum(axis=1))
        worst = float(found[k - 1]) if len(found) >= k else np.inf
        alive, partial, seen = np.flatnonzero(other), None, 0
        for block in columns:
            part = turned_asked[number, seen:seen + len(block)]
            gap = (block if partial is None and len(alive) == len(points) else block[:, alive]
                   ) - part[:, None]
            step = np.einsum("ij,ij->j", gap, gap)
            partial = step if partial is None else partial + step
            seen += len(block)
            if seen < size:
                limit = worst * (1 + search.allowance / np.sqrt(seen)) ** 2 * seen / size
                kept = partial <= limit + 1e-6
                alive, partial = alive[kept], partial[kept]
        if len(partial) > k:
            edge = np.partition(partial, k - 1)[k - 1]
            alive = alive[partial <= edge + 1e-5]
        score = (points[alive] * asked[number]).sum(axis=1)
        best = np.lexsort((row_ids[alive], -score))[:k]
        yield np.full(len(best), query_ids[number]), row_ids[alive[best]], score[best]


def neighbours(df: DataFrame, queries: DataFrame, search: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of ``df`` (vec_id, embedding) found for every
    row of ``queries`` (the same columns)."""
    schema = "query_id bigint, rank int, vec_id bigint, score double"

    def clean(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("v")).filter(
            F.col("vec_id").isNotNull() & usable("v"))

    points = clean(df)
    asked = clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    found = [_found(points.filter(F.size("v") == size), asked.filter(F.size("v") == size), size, search)
             for size in lengths(points, "v")]
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionByName, found)


def _found(points: DataFrame, asked: DataFrame, size: int, search: Search) -> DataFrame:
    """The neighbours of vectors of one length."""
    index = fit(sample(points, "vec_id", "v", size, search.sample, search.seed), points.count(), search)

    def assign(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = column_matrix(batch.column(1), size)
                lists = _nearest_lists(unit(vectors), index.centroids, probes)
                times = lists.shape[1]
                ids = np.repeat(batch.column(0).to_numpy(), times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.reshape(-1).astype(np.int32)), pa.array(ids),
                     pa.array(np.repeat([v.tobytes() for v in vectors], times).tolist(),
                              pa.binary())],
                    names=["list", "id", "v"])

        return run

    kind = "list int, id bigint, v binary"
    stored = written(points.mapInArrow(assign(1), kind), "lists")
    probing = written(asked.mapInArrow(assign(index.probes), kind), "probes")

    def blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    # One row per list that is probed, at most ``most_lists``.
    grid = F.broadcast(blocks(stored, search.rows_block, "parts").join(
        blocks(probing, search.queries_block, "turns"), "list"))

    def dealt(rows: DataFrame, mine: str, others: str, is_row: bool) -> DataFrame:
        """Every row meets every block of the other side."""
        own = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        placed = rows.join(grid, "list").select("list", own.alias(mine), other.alias(others), "id", "v")
        return placed.select(
            F.xxhash64("list", "parts", "turns").alias("key"), F.lit(is_row).alias("is_row"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides in _groups(batches):
            if not all(ids for ids, _ in sides):
                continue
            (query_ids, q), (row_ids, v) = (
                (np.array(ids), np.frombuffer(b"".join(blobs), dtype="<f8").reshape(-1, size))
                for ids, blobs in sides)
            found = list(scan(index, search, q, query_ids, v, row_ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(column)) for column in zip(*found)],
                names=["query_id", "vec_id", "score"])

    met = dealt(stored, "parts", "turns", True).union(dealt(probing, "turns", "parts", False))
    found = met.repartition(shuffle_width(points.sparkSession), "key").sortWithinPartitions(
        "key", "is_row").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= search.nearest).select("query_id", "rank", "vec_id", "score")


def _groups(batches: Iterator[pa.RecordBatch]):
    """(query ids, vectors), (row ids, vectors) of one block after the other."""
    now, sides = None, (([], []), ([], []))
    for batch in batches:
        for key, is_row, id_, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key != now:
                if now is not None:
                    yield sides
                now, sides = key, (([], []), ([], []))
            sides[is_row][0].append(id_)
            sides[is_row][1].append(blob)
    if now is not None:
        yield sides


def search_table(embeddings: DataFrame, every: int = 50, search: Search = Search()) -> DataFrame:
    """The neighbours of the rows whose id is divisible by ``every`` among all rows."""
    return neighbours(embeddings, embeddings.filter(F.col("vec_id") % every == 0), search)
