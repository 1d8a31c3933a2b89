"""Bootstrap draws of exactly n rows, and intervals of quantiles from mergeable sketches.

**Exactly n.** A replicate of ``multinomial_sums`` is a draw of n rows with replacement, n the rows of
its group. Rows that agree in all values are one cell. The draw goes down a tree of conditional
binomials: from the group to its parts (cells dealt by a hash, about ``part_cells`` each), then inside
every part to its cells. What exists at any time is the sums of parts by replicates and, inside a
task, one block of replicates over one part; rows times replicates exist nowhere. The cost is cells
times replicates. The generator of a draw depends on (seed, group, part) alone, and cells have an
order of their own, so results do not depend on partitioning.

**Quantiles.** ``quantile_intervals`` sketches every (group, bucket) by counts between cut values that
are shared by a group, so sketches of buckets add up: a replicate merges them with its Poisson
weights in one matrix product, and no value meets a replicate. Half of the ``cuts`` are even in rank;
the others divide the ranks within ``reach`` standard errors of each quantile, where the quantiles of
replicates lie. Ranks at cuts are exact; inside a cell with more than one distinct value the quantile
is interpolated between its least and greatest value. So the error is at most the value range of one
cell, that is 2 * reach / cuts * len(quantiles) standard errors of rank (below 0.03 with the
defaults), plus the part of the interval that the buckets leave (see ``resampling``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.functions.scoring import calibration_bin
from calibrant.operators.cleaning import demanded
from calibrant.operators.resampling import LEVEL, bucket_of, bucket_weights, replicate_estimate
from calibrant.session import stored

_BLOCK = 128


def _generator(*key) -> np.random.Generator:
    digest = hashlib.sha256("|".join(map(repr, key)).encode()).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest[:16], "little")))


def _rest(kinds: Mapping[str, str], names: Sequence[str]) -> str:
    return "".join(f"`{name}` {kinds[name]}, " for name in names)


def multinomial_sums(
    df: DataFrame, by: Sequence[str], values: Sequence[str], within: Sequence[str] = (),
    reps: int = 2000, seed: int | str = 0, part_cells: int = 4096,
) -> DataFrame:
    """``(by..., within..., rep, weight, values...)`` of draws of exactly n rows per group ``by``.

    Weights of a replicate add up to n over ``within``. ``values`` must not be NULL. Replicate -1 is
    the data itself. A group and ``within`` value that a replicate misses has no row in it.
    """
    if not by:
        one = multinomial_sums(df.withColumn("_all", F.lit(0)), ["_all"], values, within, reps, seed, part_cells)
        return one.drop("_all")
    by, values, within = list(by), list(values), list(within)
    cells = stored(df.groupBy(*by, *within, *[F.col(v).cast("double").alias(v) for v in values]).agg(
        F.count(F.lit(1)).alias("_n")), "cells")
    kinds = dict(cells.dtypes)
    keys = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in [*within, *values]]
    parts = cells.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / part_cells).alias("_parts"))
    parted = _with_groups(cells, parts, by).withColumn(
        "_part", F.pmod(F.xxhash64(*keys), F.col("_parts"))).drop("_parts")
    totals = parted.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))

    def deal(group: pa.Table) -> pa.Table:
        """How many draws each part gets in each replicate; a row per part."""
        order = np.argsort(group.column("_part").to_numpy())
        group = group.take(pa.array(order))
        n = group.column("_n").to_numpy()
        name = [group.column(b)[0].as_py() for b in by]
        drawn = _generator("parts", seed, *name).multinomial(int(n.sum()), n / n.sum(), size=reps)
        return pa.table(
            [group.column(b) for b in by] + [group.column("_part"), pa.array(list(drawn.T), pa.list_(pa.int64()))],
            names=[*by, "_part", "_draws"])

    draws = totals.groupBy(*by).applyInArrow(deal, _rest(kinds, by) + "_part bigint, _draws array<bigint>")
    theirs = {b: f"_by{i}" for i, b in enumerate(by)} | {"_part": "_of"}
    draws = draws.withColumnsRenamed(theirs)
    same = [F.col(f"`{b}`").eqNullSafe(F.col(theirs[b])) for b in [*by, "_part"]]
    # The draws come with the first cell of a part only.
    first = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*within, *values)) == 1
    met = parted.withColumn("_first", first).join(draws, _all([*same, F.col("_first")]), "left").drop(
        *theirs.values(), "_first")

    def spread(part: pa.Table) -> pa.Table:
        name = [part.column(b)[0].as_py() for b in [*by, "_part"]]
        part = part.sort_by([(c, "ascending") for c in [*within, *values]])
        n = part.column("_n").to_numpy()
        draws = next(x for x in part.column("_draws").to_pylist() if x is not None)
        columns = np.stack([np.ones(len(n)), *[part.column(v).to_numpy() for v in values]], axis=1)
        label, code = _labels(part, within)
        generator, out = _generator("cells", seed, *name), []
        for begin in range(-1, reps, _BLOCK):
            block = range(begin, min(begin + _BLOCK, reps))
            drawn = np.stack([n if r < 0 else generator.multinomial(draws[r], n / n.sum()) for r in block])
            for one in range(len(label)):
                mine = code == one
                out.append((one, np.array(block), drawn[:, mine] @ columns[mine]))
        which = np.concatenate([np.full(len(reps_), one) for one, reps_, _ in out])
        sums = np.concatenate([sums for _, _, sums in out])
        zero = pa.array(np.zeros(len(which), dtype=np.int64))
        return pa.table(
            [part.column(b).take(zero) for b in by] + [part.column(w).take(pa.array(label[which])) for w in within]
            + [pa.array(np.concatenate([reps_ for _, reps_, _ in out]).astype(np.int32))]
            + [pa.array(column) for column in sums.T], names=[*by, *within, "rep", "weight", *values])

    schema = _rest(kinds, [*by, *within]) + ", ".join(["rep int", "weight double"] + [f"`{v}` double" for v in values])
    parts = met.groupBy(*by, "_part").applyInArrow(spread, schema)
    return parts.groupBy(*by, *within, "rep").agg(
        F.sum("weight").alias("weight"), *[F.sum(v).alias(v) for v in values]).where("weight > 0")


def _with_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], most: int = 1 << 12) -> DataFrame:
    """The columns of a row's group. Up to ``most`` groups, which are counted, are broadcast, so that
    rows of a large group stay where they are; beyond, no group is far above the others."""
    groups = stored(groups.withColumnsRenamed({b: f"_by{i}" for i, b in enumerate(by)}), "groups")
    same = _all([F.col(f"`{b}`").eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
    few = groups.count() <= most
    return rows.join(F.broadcast(groups) if few else groups, same).drop(*[f"_by{i}" for i in range(len(by))])


def _all(conditions: Sequence[Column]) -> Column:
    whole = F.lit(True)
    for condition in conditions:
        whole = whole & condition
    return whole


def _labels(part: pa.Table, within: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of every distinct ``within`` value, and which of them each row has."""
    if not within:
        return np.zeros(1, np.int64), np.zeros(part.num_rows, np.int64)
    seen: dict[tuple, int] = {}
    first, code = [], []
    for i, key in enumerate(zip(*(part.column(w).to_pylist() for w in within))):
        if key not in seen:
            seen[key] = len(seen)
            first.append(i)
        code.append(seen[key])
    return np.array(first), np.array(code)


def exact_bootstrap_ci(
    df: DataFrame, by: Sequence[str] = ("variant",), prob: str = "prob", outcome: str = "outcome",
    reps: int = 2000, seed: int | str = 0, n_bins: int = 10,
) -> DataFrame:
    """``bootstrap_ci`` with replicates that draw exactly as many rows as their group has."""
    p, y = F.col(prob).cast("double"), F.col(outcome).cast("double")
    rows = df.where(p.isNotNull() & y.isNotNull()).select(
        *by, calibration_bin(p, n_bins).alias("_bin"), p.alias("_p"), y.alias("_y"), ((p - y) * (p - y)).alias("_sq"))
    sums = multinomial_sums(rows, by, ["_p", "_y", "_sq"], ["_bin"], reps, seed)
    each = sums.groupBy(*by, "rep").agg(
        (F.sum("_sq") / F.sum("weight")).alias("brier"),
        (F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.sum("weight")).alias("ece"))
    return each.groupBy(*by).agg(*replicate_estimate(F.col("brier"), "brier"), *replicate_estimate(F.col("ece"), "ece"))


def quantile_intervals(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float] = (0.5,),
    reps: int = 2000, seed: int | str = 0, row_id: str = "row_id", cuts: int = 2048, reach: float = 8.0,
) -> DataFrame:
    """``(by..., quantile, n, estimate, lo, hi)``: quantiles of ``value`` with 95 % intervals.

    A quantile is interpolated between the two nearest rows, as ``percentile`` does. Rows without a
    value do not count; NULL ids are refused. Every group has ``BUCKETS`` sketches at most.
    """
    if not by:
        one = quantile_intervals(df.withColumn("_all", F.lit(0)), ["_all"], value, quantiles, reps, seed,
                                 row_id, cuts, reach)
        return one.drop("_all")
    by, quantiles, last = list(by), list(quantiles), cuts // 2 - 1
    rows = demanded(df.where(F.col(value).isNotNull()), F.col(row_id).isNotNull(),
                    f"{row_id} is NULL: rows cannot be resampled").select(
        *by, bucket_of(row_id, seed).alias("_bucket"), F.col(value).cast("double").alias("_x"))
    kinds = dict(rows.dtypes)
    grid = F.expr(f"approx_percentile(_x, array({', '.join(map(str, np.linspace(0, 1, last + 1).tolist()))}), 100000)")
    even = stored(rows.groupBy(*by).agg(grid.alias("_even"), F.count(F.lit(1)).alias("_n")), "even-cuts")
    # Ranks near each quantile are divided more finely.
    error = F.sqrt(F.lit(1.0) / F.col("_n")) * reach / 2

    def at(rank: Column) -> Column:
        return F.get("_even", F.least(F.greatest(rank, F.lit(0)), F.lit(last)).cast("int"))

    near = _any([(F.col("_x") >= at(F.floor((q - error) * last))) & (F.col("_x") <= at(F.ceil((q + error) * last)))
                 for q in quantiles])
    fine = _with_groups(rows, even, by).where(near).groupBy(*by).agg(grid.alias("_even"))
    both = even.select(*by, "_even").unionByName(fine).groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_even")))).alias("_cuts"))
    cut = _with_groups(rows, both, by)
    # The last cut that is not above the value.
    cell = F.size(F.filter("_cuts", lambda c: c <= F.col("_x")))
    sketches = cut.select(*by, "_bucket", "_x", cell.alias("_cell")).groupBy(*by, "_bucket", "_cell").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))

    def draw(group: pa.Table) -> pa.Table:
        cells, code = np.unique(group.column("_cell").to_numpy(), return_inverse=True)
        counts = np.zeros((int(group.column("_bucket").to_numpy().max()) + 1, len(cells)))
        counts[group.column("_bucket").to_numpy(), code] = group.column("_rows").to_numpy()
        low, high = np.full(len(cells), np.inf), np.full(len(cells), -np.inf)
        np.minimum.at(low, code, group.column("_low").to_numpy())
        np.maximum.at(high, code, group.column("_high").to_numpy())
        merged = np.cumsum(bucket_weights(reps, seed)[:, :len(counts)] @ counts, axis=1)
        found = []
        for q in quantiles:
            each = np.array([_at_rank(upto, low, high, q) for upto in merged])
            lo, hi = np.nanpercentile(each[1:], [100 * level for level in LEVEL])
            found.append((q, int(merged[0, -1]), each[0], lo, hi))
        zero = pa.array(np.zeros(len(found), dtype=np.int64))
        q, n, estimate, lo, hi = zip(*found)
        return pa.table([group.column(b).take(zero) for b in by] + [
            pa.array(q, pa.float64()), pa.array(n, pa.int64()), pa.array(estimate, pa.float64()),
            pa.array(lo, pa.float64()), pa.array(hi, pa.float64())],
            names=[*by, "quantile", "n", "estimate", "lo", "hi"])

    return sketches.groupBy(*by).applyInArrow(
        draw, _rest(kinds, by) + "quantile double, n bigint, estimate double, lo double, hi double")


def _any(conditions: Sequence[Column]) -> Column:
    whole = F.lit(False)
    for condition in conditions:
        whole = whole | condition
    return whole


def _at_rank(upto: np.ndarray, low: np.ndarray, high: np.ndarray, q: float) -> float:
    """The value at rank q * (W - 1) of cells with running counts ``upto``."""
    whole = upto[-1]
    if whole == 0:
        return float("nan")
    place = q * (whole - 1)
    below = np.floor(place)

    def row(rank: float) -> float:
        cell = int(np.searchsorted(upto, rank, side="right"))
        begin = upto[cell - 1] if cell else 0.0
        size = upto[cell] - begin
        share = (rank - begin) / (size - 1) if size > 1 else 0.5
        return low[cell] + (high[cell] - low[cell]) * share

    first = row(below)
    return first if place == below else first + (row(below + 1) - first) * (place - below)
