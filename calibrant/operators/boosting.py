"""Gradient-boosted trees for a binary outcome, grown from histograms of weighted cells.

Features are cut into at most ``bins`` ranges, and rows that agree in every range become one cell with
its number of rows and of positive outcomes, once and before the first tree. The cells stay
partitioned; every level of every tree is one pass over them that adds, per node, feature and range,
the gradient, the curvature and the rows. Those sums, at most 2^(depth - 1) x features x (bins + 1)
rows, are all that leaves a task. Sums are taken of the smaller child of a node; the other has the
rest of its parent's.

In between, cells lie in persisted blocks with their scores and gradients, made anew by each tree from
those of the tree before. Scores of cells are written now and then, and blocks begin again from the
written ones, so neither plans nor lineages get longer with the rounds.

Gradients are rounded to whole multiples of 2^-26 a row and added as integers: a sum is the same for
every partitioning (and an error, not a wrong number, above 2^37 rows).

A missing value (NULL or NaN) has a range of its own, and each split says to which side it goes: the
better one where the node has such rows, else the side with more rows. Rows without an outcome
train nothing. No rows, or outcomes that are all alike, give a forecast without trees.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.operators.cleaning import demanded
from calibrant.session import stored

ONE = 1 << 26
_MOST = 1e-9   # base rates are kept this far from 0 and 1


@dataclass(frozen=True)
class Boosting:
    """Parameters of a forecast by boosted trees."""

    rounds: int = 400
    depth: int = 4
    rate: float = 0.05
    bins: int = 255
    l2: float = 1.0         # added to the curvature of a leaf
    least_rows: int = 20    # on either side of a split
    kept_trees: int = 20    # scores of cells are written each time so many trees are new


@dataclass
class Forest:
    """Trees as heaps: node i has the children 2 i and 2 i + 1, and the root is 1."""

    depth: int
    feature: np.ndarray       # (trees, 2^depth): which feature a node asks
    last: np.ndarray          # the last range that goes left
    missing_left: np.ndarray
    leaf: np.ndarray          # (trees, 2^depth): what the leaf adds to the log odds

    @classmethod
    def empty(cls, depth: int) -> Forest:
        width = 1 << depth
        return cls(depth, np.zeros((0, width), np.int16), np.zeros((0, width), np.int16),
                   np.zeros((0, width), bool), np.zeros((0, width)))

    def __len__(self) -> int:
        return len(self.leaf)

    def since(self, tree: int) -> Forest:
        return Forest(self.depth, self.feature[tree:], self.last[tree:], self.missing_left[tree:],
                      self.leaf[tree:])

    def grown(self, tree: Tree) -> Forest:
        return Forest(
            self.depth, np.vstack([self.feature, tree.feature]), np.vstack([self.last, tree.last]),
            np.vstack([self.missing_left, tree.missing_left]), np.vstack([self.leaf, tree.leaf]))

    def added(self, ranges: np.ndarray) -> np.ndarray:
        """What the trees add to the log odds of rows of ``ranges`` (one column per feature)."""
        total, ranges = np.zeros(len(ranges)), np.ascontiguousarray(ranges.T)
        for t in range(len(self)):
            node = _descend(ranges, self.feature[t], self.last[t], self.missing_left[t], self.depth)
            total += self.leaf[t][node - (1 << self.depth)]
        return total


@dataclass
class Tree:
    depth: int
    feature: np.ndarray = field(init=False)
    last: np.ndarray = field(init=False)
    missing_left: np.ndarray = field(init=False)
    leaf: np.ndarray = field(init=False)

    def __post_init__(self):
        width = 1 << self.depth
        # A node that is not split sends every row to the left.
        self.feature = np.zeros(width, np.int16)
        self.last = np.full(width, np.iinfo(np.int16).max, np.int16)
        self.missing_left = np.ones(width, bool)
        self.leaf = np.zeros(width)


def _descend(ranges, feature, last, missing_left, levels: int) -> np.ndarray:
    """The node of each row (a row of ``ranges`` per feature) after so many levels."""
    columns = _unsigned(ranges)
    top = np.iinfo(columns.dtype).max
    node = np.ones(columns.shape[1], np.min_scalar_type((2 << levels) - 1))
    turns = []
    for level in range(levels):
        if level < WHOLE:
            # Whole columns are asked for every node, which costs less than a look-up per row.
            sides = []
            for i in range(1 << level, 2 << level):
                mine = columns[feature[i]]
                right = mine > int(last[i])
                sides.append(right & (mine != top) if missing_left[i] else right)
            for turn in reversed(turns):
                sides = [left ^ ((left ^ right) & turn) for left, right in zip(sides[::2], sides[1::2])]
            turns += sides
        else:
            mine = columns[feature[node], np.arange(len(node))]
            turns.append((mine > last[node]) & ~((mine == top) & missing_left[node]))
        node = (node << 1) | turns[-1]
    return node


def _unsigned(ranges: np.ndarray) -> np.ndarray:
    """Ranges without sign: a missing one is above all others, and one more is 0."""
    return ranges.view(f"u{ranges.itemsize}")


@dataclass
class Booster:
    """A fitted forecast: cut values of each feature, the base log odds, and the trees."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    forest: Forest

    def probability(self) -> Column:
        """The forecast as a column over the features."""
        cuts, base, forest = self.cuts, self.base, self.forest

        @F.pandas_udf("double")
        def forecast(*columns):
            import pandas as pd

            ranges = _ranges([c.to_numpy(dtype=float) for c in columns], cuts)
            return pd.Series(_sigmoid(base + forest.added(ranges)))

        return forecast(*[F.col(f"`{f}`").cast("double") for f in self.features])


def fit(
    train: DataFrame, features: Sequence[str], outcome: str = "outcome", settings: Boosting = Boosting(),
    cuts: Mapping[str, Sequence[float]] | None = None,
) -> Booster:
    """Trees for ``outcome`` (0 or 1) of ``train``.

    ``cuts`` gives cut values of features; the others are cut at quantiles of their values, whose
    ranks are right within 1 in 100 000. A value lies in the range of the cuts below it.
    """
    features, given = list(features), dict(cuts or {})
    y = F.col(f"`{outcome}`").cast("double")
    rows = demanded(train, F.coalesce(y.isin(0.0, 1.0), F.lit(True)), "outcomes must be 0 or 1").where(
        y.isNotNull()).select(
        *[F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None)).alias(f"x{i}") for i, f in enumerate(features)],
        y.cast("bigint").alias("y"))
    edges = _edges(rows, features, given, settings.bins)
    cells = stored(_cells(rows, edges).repartition(train.sparkSession.sparkContext.defaultParallelism), "cells")
    n, positive = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = min(max(positive / n, _MOST), 1 - _MOST) if n else 0.5
    base, forest = float(np.log(share / (1 - share))), Forest.empty(settings.depth)
    booster = Booster(features, edges, base, forest)
    if positive in (0, n):
        return booster
    known, blocks, tree = 0, None, None
    cells = cells.withColumn("score", F.lit(base))
    for _ in range(settings.rounds):
        if len(forest) - known >= settings.kept_trees:
            cells = stored(_scored(cells, len(edges), forest.since(known)), "cells")
            known, tree = len(forest), None
        before, blocks = blocks, (_blocks(cells, len(edges)) if tree is None else blocks.map(partial(_after, tree))
                                  ).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        tree = _grown(blocks, edges, settings)
        forest = forest.grown(tree)
        if before is not None:
            before.unpersist()
    if blocks is not None:
        blocks.unpersist()
    return Booster(features, edges, base, forest)


def _edges(rows: DataFrame, features: list[str], given: dict, bins: int) -> list[np.ndarray]:
    """Ascending cut values per feature: between values that are neighbours among ``bins`` quantiles."""
    grid = ", ".join(map(str, np.linspace(0, 1, bins + 1).tolist()))
    asked = [i for i, f in enumerate(features) if f not in given]
    found = rows.agg(*[F.expr(f"approx_percentile(x{i}, array({grid}), 100000)").alias(f"x{i}") for i in asked]
                     ).first() if asked else None
    out = []
    for i, name in enumerate(features):
        if name in given:
            out.append(np.unique(np.asarray(given[name], dtype=float)))
            continue
        values = np.unique(np.asarray(found[f"x{i}"] or [], dtype=float))
        out.append(values[:-1] + np.diff(values) / 2 if np.isfinite(values).all() else values[:-1])
    return out


def _ranges(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """How many cuts lie below each value; -1 where it is missing."""
    return np.stack([
        np.where(np.isnan(x), -1, np.searchsorted(edges, x, side="left")) for x, edges in zip(columns, cuts)
    ], axis=1).astype(np.int16)


def _cells(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """One row per combination of ranges: the ranges, its rows ``n`` and its positive ones ``y``."""
    names = [f"b{i}" for i in range(len(cuts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = _ranges([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], cuts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column) for column in ranges.T] + [batch.columns[-1]], names=[*names, "y"])

    schema = ", ".join([f"{name} smallint" for name in names] + ["y bigint"])
    return rows.mapInArrow(run, schema).groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))


def _sigmoid(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-score))


BLOCK = 1 << 16         # cells of a block
WHOLE = 5               # levels that are gone down by whole columns
LIGHT = 31              # rows of a cell whose gradients 32 bits hold
EXACT = 1 << 26         # rows whose gradients a sum of doubles holds exactly


@dataclass
class _Cells:
    """A block of cells: ranges (a row per feature), rows, positive ones, the score that is written,
    what the trees since add to it, gradients and curvatures. Blocks are read at every level, so their
    numbers take as few bytes as hold them."""

    ranges: np.ndarray
    n: np.ndarray
    y: np.ndarray
    score: np.ndarray
    since: np.ndarray
    g: np.ndarray = None
    h: np.ndarray = None

    def weighed(self) -> _Cells:
        p = _sigmoid(self.score + self.since)
        kind = np.int32 if self.n.max(initial=0) <= LIGHT else np.int64
        g = self.n * np.rint(p * ONE).astype(np.int64) - self.y * np.int64(ONE)
        h = self.n * np.rint(p * (1 - p) * ONE).astype(np.int64)
        return replace(self, g=g.astype(kind), h=h.astype(kind))

    def nodes(self, tree: Tree, levels: int) -> np.ndarray:
        return _descend(self.ranges, tree.feature, tree.last, tree.missing_left, levels)

    def add_to(self, sums: np.ndarray, slot: np.ndarray) -> None:
        """Adds to ``sums`` (feature, slot, range + 1, [gradient, curvature, rows]) what cells with a slot have."""
        mine = slice(None) if slot.min(initial=0) >= 0 else np.flatnonzero(slot >= 0)
        weights = [x[mine] for x in (self.g, self.h, self.n)]
        exact = int(weights[2].sum()) < EXACT
        if exact:
            weights = [weight.astype(float) for weight in weights]
        features, slots, width, _ = sums.shape
        first, above = slot[mine] * width, _unsigned(self.ranges) + _unsigned(np.ones(1, self.ranges.dtype))
        for f in range(features):
            place, totals = above[f][mine].astype(np.int64), sums[f].reshape(-1, 3)
            if slots > 1:
                place += first
            for i, weight in enumerate(weights):
                if exact:
                    totals[:, i] += np.bincount(place, weight, slots * width).astype(np.int64)
                else:
                    np.add.at(totals[:, i], place, weight)


def _blocks(cells: DataFrame, features: int) -> RDD:
    """Cells with their written scores, in blocks."""
    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], names=["block"])

    return cells.mapInArrow(run, "block binary").rdd.map(partial(_opened, features))


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together to at most ``size`` rows, unless one has more."""
    some, rows = [], 0
    for batch in batches:
        if some and rows + batch.num_rows > size:
            yield pa.Table.from_batches(some)
            some, rows = [], 0
        some.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(some)


def _opened(features: int, row) -> _Cells:
    columns = [c.to_numpy() for c in pa.ipc.open_stream(bytes(row.block)).read_all().columns]
    (n, y, score), ranges = columns[features:], np.stack(columns[:features])
    if ranges.max(initial=0) < 255:
        ranges = ranges.astype(np.uint8)   # a missing one is 255
    kind = np.min_scalar_type(int(n.max()))
    return _Cells(ranges, n.astype(kind), y.astype(kind), score, np.zeros(len(n))).weighed()


def _after(tree: Tree, cells: _Cells) -> _Cells:
    """Cells once ``tree`` is grown."""
    _spare_imports()
    leaf = tree.leaf[cells.nodes(tree, tree.depth) - (1 << tree.depth)]
    return replace(cells, since=cells.since + leaf).weighed()


def _grown(blocks: RDD, cuts: list[np.ndarray], settings: Boosting) -> Tree:
    """One tree on top of the scores of ``blocks``."""
    tree, width = Tree(settings.depth), max(map(len, cuts)) + 2
    sums = _histograms(blocks, tree, 0, np.zeros(2, np.int64), (len(cuts), 1, width, 3))
    for level in range(settings.depth):
        first, final = 1 << level, level == settings.depth - 1
        rows = [[int(side[2]) for side in _split(tree, first + i, sums[i], cuts, settings, final)]
                for i in range(first)]
        if final:
            break
        # The smaller side of every node that has two; the others follow.
        smaller, slot, asked = [int(two < one) for one, two in rows], np.full(4 * first, -1), 0
        for i, sides in enumerate(rows):
            if min(sides):
                slot[2 * (first + i) + smaller[i]] = asked
                asked += 1
        if asked:
            found = _histograms(blocks, tree, level + 1, slot, (len(cuts), asked, width, 3))
        below = np.zeros((2 * first, *sums.shape[1:]), np.int64)
        for i, side in enumerate(smaller):
            at = slot[2 * (first + i) + side]
            if at >= 0:
                below[2 * i + side] = found[at]
            below[2 * i + 1 - side] = sums[i] - below[2 * i + side]
        sums = below
    return tree


def _histograms(blocks: RDD, tree: Tree, level: int, slot: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sums (slot, feature, range + 1, [gradient, curvature, rows]) of the nodes of a level that have a slot."""
    parts = blocks.mapPartitions(partial(_summed, tree, level, slot, shape))
    if blocks.getNumPartitions() > 64:
        found = parts.treeReduce(np.add)
    else:
        found = sum(parts.collect(), np.zeros(shape, np.int64))
    return found.swapaxes(0, 1)


def _summed(tree: Tree, level: int, slot: np.ndarray, shape: tuple[int, ...], blocks: Iterator[_Cells]) -> Iterator[np.ndarray]:
    _spare_imports()
    sums = np.zeros(shape, np.int64)
    for cells in blocks:
        cells.add_to(sums, slot[cells.nodes(tree, level)])
    yield sums


@cache
def _spare_imports() -> None:
    """Takes imported modules out of the garbage collection that ends each task of a kept worker: at
    hundreds of short tasks a worker it takes longer than the sums. Once a worker: to ask how many
    objects are out takes as long as a collection."""
    gc.freeze()


def _scored(cells: DataFrame, features: int, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            added = forest.added(np.stack(columns[:features], axis=1))
            yield batch.set_column(features + 2, "score", pa.array(columns[features + 2] + added))

    return cells.mapInArrow(run, cells.schema)


def _split(
    tree: Tree, node: int, sums: np.ndarray, cuts, settings: Boosting, final: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """The best split of a node; of equal ones that of the first feature and the lowest cut.

    Returns the sums of its two sides.
    """
    whole = sums[0].sum(axis=0)
    best, sides = 0.0, (whole, np.zeros(3, np.int64))
    for f, edges in enumerate(cuts):
        known, missing = sums[f, 1:len(edges) + 2], sums[f, 0]
        left = np.cumsum(known, axis=0)
        if not missing[2]:
            left = left[:-1]
        for goes_left in ((True, False) if missing[2] else (None,)):
            one = left + missing if goes_left else left
            two = whole - one
            gain = _worth(one, settings.l2) + _worth(two, settings.l2) - _worth(whole, settings.l2)
            allowed = np.minimum(one[:, 2], two[:, 2]) >= max(settings.least_rows, 1)
            gain = np.where(allowed, gain, -np.inf)
            at = int(np.argmax(gain)) if len(gain) else -1
            if at >= 0 and gain[at] > best:
                best, sides = float(gain[at]), (one[at], two[at])
                tree.feature[node], tree.last[node] = f, at
                tree.missing_left[node] = goes_left if missing[2] else one[at, 2] >= two[at, 2]
    if final:
        for child, (g, h, _) in zip((2 * node, 2 * node + 1), sides):
            at = child - (1 << tree.depth)
            tree.leaf[at] = -settings.rate * (g / ONE) / (h / ONE + settings.l2)
    return sides


def _worth(sums: np.ndarray, l2: float) -> np.ndarray:
    g, h = sums[..., 0] / ONE, sums[..., 1] / ONE
    return g * g / np.maximum(h + l2, 1e-12)
