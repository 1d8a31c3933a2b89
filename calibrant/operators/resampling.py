"""Bootstrap intervals that never hold rows times replicates.

Rows are dealt to ``BUCKETS`` random buckets by a digest of their id and summed per group and bucket,
so a group of any size has at most that many rows when replicates are drawn. A replicate takes every
bucket a Poisson(1) number of times. As the buckets are random parts of the data, a replicate's sum
has the spread of a resample of rows; below ``BUCKETS`` rows nearly every row has a bucket of its own.
The same rule holds at every size.

Weights are a function of (seed, replicate, bucket) in 32-bit integer arithmetic: they do not depend
on partitioning, are the same on a second run, and any SQL engine can repeat them. They are shared by
all groups, so groups are compared on the same replicates.

Every replicate is divided by its own total weight. Replicate -1 is the data itself, so an estimate
and its interval come out of the same pass.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.scoring import calibration_bin
from calibrant.operators.cleaning import demanded

LEVEL = (0.025, 0.975)
BUCKETS = 1024
#: 2^32 times the distribution function of Poisson(1) at 0, 1, 2, ...
POISSON_STEPS = (
    1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777,
    4294923276, 4294962463, 4294966817, 4294967252, 4294967292, 4294967295)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers held in 64 bits."""
    low = np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x7FEB352D)) & low
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(0x846CA68B)) & low
    return x ^ (x >> np.uint64(16))


def seed_start(seed: int | str) -> int:
    """Where the count of draws begins for a seed."""
    return int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16)


@functools.lru_cache(maxsize=4)
def bucket_weights(reps: int, seed: int | str) -> np.ndarray:
    """Row 0 is the data itself, all ones; then a row per replicate and a column per bucket."""
    number = np.arange(reps * BUCKETS, dtype=np.uint64) + np.uint64(seed_start(seed))
    uniform = scramble(number & np.uint64(0xFFFFFFFF))
    drawn = np.searchsorted(np.array(POISSON_STEPS, dtype=np.uint64), uniform, side="right")
    out = np.ones((reps + 1, BUCKETS))
    out[1:] = drawn.reshape(reps, BUCKETS)
    return out


def bucket_of(row_id: str, seed: int | str) -> Column:
    """The bucket of a row; rows with a NULL id would share one."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(row_id).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % BUCKETS).cast("int")


def replicate_sums(
    df: DataFrame, by: Sequence[str], values: Sequence[str], row_id: str = "row_id",
    reps: int = 2000, seed: int | str = 0,
) -> DataFrame:
    """``(by..., rep, weight, values...)``: weight and weighted sums per group and replicate.

    ``values`` must not be NULL. A NULL id is refused: such rows would move together, and a group of
    them would have an interval without width. Rows are summed per bucket before the shuffle; what is drawn for
    one group at a time is at most ``BUCKETS`` rows.
    """
    by, values = list(by), list(values)
    rows = demanded(df, F.col(row_id).isNotNull(), f"{row_id} is NULL: rows cannot be resampled")
    sums = rows.groupBy(*by, bucket_of(row_id, seed).alias("_bucket")).agg(
        F.count(F.lit(1)).cast("double").alias("_rows"),
        *[F.sum(F.col(v).cast("double")).alias(v) for v in values])
    kinds = dict(sums.dtypes)
    schema = ", ".join([f"`{b}` {kinds[b]}" for b in by] + ["rep int", "weight double"]
                       + [f"`{v}` double" for v in values])

    def draw(group: pa.Table) -> pa.Table:
        bucket = group.column("_bucket").to_numpy()
        columns = [group.column(c).to_numpy() for c in ["_rows", *values]]
        drawn = bucket_weights(reps, seed)[:, bucket] @ np.stack(columns, axis=1)
        first = pa.array(np.zeros(reps + 1, dtype=np.int64))
        return pa.table(
            [group.column(b).take(first) for b in by]
            + [pa.array(np.arange(-1, reps, dtype=np.int32))]
            + [pa.array(column) for column in drawn.T], names=[*by, "rep", "weight", *values])

    return sums.groupBy(*by).applyInArrow(draw, schema)


def replicate_estimate(value: Column, name: str) -> list[Column]:
    """The value of the data and the 95 % bounds of its replicates, as aggregates."""
    replicate = F.col("rep") >= 0
    bounds = F.percentile(F.when(replicate, value), F.array(*[F.lit(q) for q in LEVEL]))
    return [F.max(F.when(~replicate, value)).alias(name),
            bounds[0].alias(f"{name}_lo"), bounds[1].alias(f"{name}_hi")]


def bootstrap_statistics(
    df: DataFrame, by: Sequence[str], values: Mapping[str, Column],
    estimates: Mapping[str, Column], within: Mapping[str, Column] | None = None,
    reps: int = 2000, seed: int | str = 0, row_id: str = "row_id",
) -> DataFrame:
    """95 % intervals of any aggregate.

    ``values`` are numbers of a row; their weighted sums and ``weight`` exist per group, per ``within``
    and per replicate, and ``estimates`` are aggregates of those over ``within``. With a calibration
    bin as ``within``, ``F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("weight")`` is the ECE. With
    the value itself as ``within``, every aggregate that takes a frequency can be resampled: the median
    is ``F.percentile("x", F.lit(0.5), F.col("weight").cast("bigint"))``.
    """
    by, within = list(by), dict(within or {})
    rows = df.select(
        *by, row_id, *[c.alias(n) for n, c in within.items()],
        *[c.cast("double").alias(n) for n, c in values.items()])
    sums = replicate_sums(rows, [*by, *within], list(values), row_id, reps, seed)
    replicates = sums.groupBy(*by, "rep").agg(*[c.alias(f"_{n}") for n, c in estimates.items()])
    return replicates.groupBy(*by).agg(
        *[column for n in estimates for column in replicate_estimate(F.col(f"_{n}"), n)])


def bootstrap_ci(
    df: DataFrame, by: Sequence[str] = ("variant",), prob: str = "prob", outcome: str = "outcome",
    reps: int = 2000, seed: int | str = 0, n_bins: int = 10, row_id: str = "row_id",
) -> DataFrame:
    """Brier score and ECE per group with 95 % percentile intervals.

    As in ``score``, rows without a probability or without an outcome do not count.
    """
    p, y = F.col(prob).cast("double"), F.col(outcome).cast("double")
    weight = F.sum("weight")
    return bootstrap_statistics(
        df.where(F.col(prob).isNotNull() & F.col(outcome).isNotNull()), by,
        {"_p": p, "_y": y, "_sq": (p - y) * (p - y)},
        {"brier": F.try_divide(F.sum("_sq"), weight),
         "ece": F.try_divide(F.sum(F.abs(F.col("_p") - F.col("_y"))), weight)},
        {"_bin": calibration_bin(p, n_bins)}, reps, seed, row_id)


def mean_intervals(sums: DataFrame, by: Sequence[str], mean: str = "mean") -> DataFrame:
    """``(by..., n, mean, lo, hi)`` from replicate sums with columns ``weight`` and ``x``."""
    n = F.max(F.when(F.col("rep") < 0, F.col("weight").cast("bigint"))).alias("n")
    return sums.groupBy(*by).agg(n, *replicate_estimate(F.try_divide("x", "weight"), mean)).select(
        *by, "n", mean, F.col(f"{mean}_lo").alias("lo"), F.col(f"{mean}_hi").alias("hi"))


def mean_ci(
    df: DataFrame, by: Sequence[str], value: str, reps: int = 2000, seed: int | str = 0,
    row_id: str = "row_id",
) -> DataFrame:
    """Mean of ``value`` per group, its 95 % interval, n, and whether the interval excludes 0."""
    known = df.where(F.col(value).isNotNull()).select(
        *by, row_id, F.col(value).cast("double").alias("x"))
    return _with_significance(mean_intervals(replicate_sums(known, by, ["x"], row_id, reps, seed), by))


def _with_significance(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def proportion_ci(
    df: DataFrame, by: Sequence[str], flags: Mapping[str, Column], reps: int = 2000,
    seed: int | str = 0, row_id: str = "row_id", name: str = "category",
) -> DataFrame:
    """``(by..., name, n, rate, lo, hi)``: the rate of every flag per group with its 95 % interval.

    All flags share one pass; a NULL flag counts as false.
    """
    columns = {f"_flag{i}": F.coalesce(flag, F.lit(False)).cast("double").alias(f"_flag{i}")
               for i, flag in enumerate(flags.values())}
    rows = df.select(*by, row_id, *columns.values())
    sums = replicate_sums(rows, by, list(columns), row_id, reps, seed)
    lines = [F.struct(F.lit(flag).alias(name), F.col(column).alias("x"))
             for flag, column in zip(flags, columns)]
    long = sums.select(*by, "rep", "weight", F.inline(F.array(*lines)))
    return mean_intervals(long, [*by, name], "rate")


def paired_differences(
    paired: DataFrame, a: str = "a", b: str = "b", market: str = "market", outcome: str = "outcome",
) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """Per-row differences of squared error and of hits, and what each column compares.

    ``paired`` has one row per item with both probabilities and the market's.
    """
    y = F.col(outcome).cast("double")

    def error(name: str) -> Column:
        return (F.col(name) - y) * (F.col(name) - y)

    def hit(name: str) -> Column:
        return ((F.col(name) > 0.5) == (y == 1)).cast("double")

    columns, meaning = [], {}
    for metric, of in (("brier", error), ("accuracy", hit)):
        for x, z in [(a, b), (a, market), (b, market)]:
            name = f"d{len(columns)}"
            meaning[name] = (metric, f"{x} - {z}")
            columns.append((of(x) - of(z)).alias(name))
    known = paired.where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(market).isNotNull()
        & F.col(outcome).isNotNull())
    return known.select("row_id", *columns), meaning


def paired_bootstrap(
    paired: DataFrame, a: str = "a", b: str = "b", market: str = "market",
    outcome: str = "outcome", reps: int = 10_000, seed: int | str = 0,
) -> DataFrame:
    """Mean paired difference, interval and significance for A-B, A-market and B-market.

    The differences of a row are resampled together, so the pairing is kept. A negative Brier
    difference, or a positive accuracy difference, favours the first of the pair. Items that lack a
    probability, the market's or the outcome do not count.
    """
    wide, meaning = paired_differences(paired, a, b, market, outcome)
    sums = replicate_sums(wide, [], list(meaning), "row_id", reps, seed)
    lines = [F.struct(F.lit(metric).alias("metric"), F.lit(pair).alias("pair"),
                      F.col(name).alias("x")) for name, (metric, pair) in meaning.items()]
    long = sums.select("rep", "weight", F.inline(F.array(*lines)))
    return _with_significance(mean_intervals(long, ["metric", "pair"]))
