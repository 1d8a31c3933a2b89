"""Exact samples and strides that do not depend on how the rows are partitioned."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.operators.ranks import every, first, select_ranks
from calibrant.session import freeze, stored

_PREFIX_DIGITS = 4
_LOCAL_BITS = 33
#: Rows of a stratum that a task passes on; up to 1000 the engine limits groups before the shuffle.
_MOST_TURNS = 1000
_SALTS = 16


def sample_order(row_id: str | Column, seed: int | str) -> Column:
    """A fixed pseudo-random order of the rows: the same on every run and partitioning.

    A NULL id counts as the empty text.
    """
    column = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(column.cast("string"), F.lit(""))))


def with_row_index(
    df: DataFrame, order_by: Sequence[str], partitions: int | None = None, name: str = "row_index"
) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given total order, without a one-task window.

    Rows are range-partitioned and sorted; the running number inside each partition is what
    ``monotonically_increasing_id`` counts. The numbered rows are frozen, because range bounds come
    from a sample and may differ on a second run, and then every partition gets the row count of
    all earlier ones. Ties in ``order_by`` are numbered arbitrarily: end it with a unique column.
    """
    ranged = (
        df.repartitionByRange(partitions, *order_by) if partitions
        else df.repartitionByRange(*order_by)
    )
    numbered = freeze(
        ranged.sortWithinPartitions(*order_by).withColumn("_id", F.monotonically_increasing_id()))
    partition = F.shiftright("_id", _LOCAL_BITS)
    sizes = numbered.groupBy(partition.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per partition, so one task and a broadcast are enough.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        numbered.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_offset", "_id")
    )


def stride_sample(
    df: DataFrame, stride: int, order_by: Sequence[str], index: str | None = None
) -> DataFrame:
    """Every ``stride``-th row of the order, from the first on: ceil(rows / stride) of them.

    Rows that tie in the order come in the order of a hash of the whole row. Give ``index`` when the
    rows already carry a dense position: then nothing is searched.
    """
    if index:
        return df.where(F.col(index) % stride == 0)
    return df if stride <= 1 else select_ranks(df, order_by, every(stride))


def take_first_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of the order, in no order; all rows when ``n`` is not positive.

    Never more than ``n``: of rows that tie at the cut, those with the smaller hash are taken.
    """
    return select_ranks(df, order_by, first(n)) if n > 0 else df


def seeded_sample_n(df: DataFrame, n: int, row_id: str, seed: int | str) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same ones for the same seed.

    The cut in the random order is found by counting: rows per prefix of the order, then, inside the
    prefix that holds the n-th row, per longer prefix, until the cut falls between two prefixes or
    inside rows of one id. Prefixes before the cut are taken whole, so however large ``n`` is, no
    task gathers more than the rows of one id.
    """
    if n <= 0:
        return df
    ordered = df.withColumn("_order", sample_order(row_id, seed))
    before, left, digits = "", n, 0
    while digits < 32:
        digits += _PREFIX_DIGITS
        prefix = F.substring("_order", 1, digits)
        inside = ordered.where(F.startswith("_order", F.lit(before)))
        # At most 16^4 rows: the next four digits of one prefix.
        sizes = inside.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for size in sorted(sizes, key=lambda row: row.p):
            if size.n >= left:
                before = size.p
                break
            left -= size.n
        else:
            return df
        if size.n == left:
            return ordered.where(prefix <= before).drop("_order")
    whole = ordered.where(F.col("_order") < before)
    tied = ordered.where(F.col("_order") == before).limit(left)
    return whole.unionByName(tied).drop("_order")


def _turns(sizes: DataFrame, n: int) -> tuple[int, int]:
    """How many whole turns n rows are, and how many rows of the turn after that; -1 turns for all.

    Sizes above n count as n, so at most n numbers come to the driver.
    """
    counted = sizes.groupBy(F.least("_size", F.lit(n)).alias("s")).agg(F.count(F.lit(1)).alias("strata")).collect()
    if sum(row.s * row.strata for row in counted) <= n:
        return -1, 0
    turns, taken, strata = 0, 0, sum(row.strata for row in counted)
    for row in sorted(counted, key=lambda row: row.s):
        steps = min(row.s - turns, (n - taken) // strata)
        taken, turns = taken + steps * strata, turns + steps
        if turns < row.s:
            break
        strata -= row.strata
    return turns, n - taken


def stratified_sample(
    df: DataFrame, n: int, strata: Sequence[str], row_id: str, seed: int | str
) -> DataFrame:
    """Round-robin over the strata, largest stratum first, until ``n`` rows are drawn.

    Sizes of strata are a table of their own; which turn is the last follows from how many strata have
    which size. In the turn that is not complete the largest strata give their row. A stratum's rows
    come by a fixed random order: every task keeps the first ones of each stratum, at most as many as
    there are turns, salted groups of a stratum do the same, and only those meet. With more than
    ``_MOST_TURNS`` turns the cut of a stratum is found by counting prefixes of the order instead; the
    input is then stored once, so pass only the columns needed.
    """
    strata = list(strata)
    if n <= 0:
        return df.limit(0)
    sizes = stored(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size")), "strata-sizes")
    turns, rest = _turns(sizes, n)
    if turns < 0:
        return df
    largest = select_ranks(
        sizes.where(F.col("_size") > turns).withColumn("_down", -F.col("_size")), ["_down", *strata], first(rest))
    names = [f"_stratum{i}" for i in range(len(strata))]
    also = largest.select(*[F.col(s).alias(name) for s, name in zip(strata, names)])
    if rest == 0:
        also = also.limit(0)
    ordered = df.withColumn("_order", sample_order(row_id, seed))
    if turns >= _MOST_TURNS:
        quotas = _with_quotas(sizes, also, strata, names, turns)
        return _by_prefix(ordered, quotas, strata, names, row_id).select(*df.columns)
    salt = F.pmod(F.xxhash64(F.col(row_id)), F.lit(_SALTS))
    rows = ordered.withColumn("_salt", salt)
    for group in ([*strata, "_salt"], strata):
        turn = F.row_number().over(Window.partitionBy(*group).orderBy("_order", row_id))
        rows = rows.withColumn("_turn", turn).where(F.col("_turn") <= turns + (rest > 0))
    whole = rows.where(F.col("_turn") <= turns).select(*df.columns)
    if rest == 0:
        return whole
    last = rows.where(F.col("_turn") == turns + 1).join(also, _same(strata, names), "left_semi")
    return whole.unionByName(last.select(*df.columns))


def _same(strata: Sequence[str], names: Sequence[str]) -> Column:
    return reduce(and_, [F.col(s).eqNullSafe(F.col(name)) for s, name in zip(strata, names)])


def _with_quotas(
    sizes: DataFrame, also: DataFrame, strata: Sequence[str], names: Sequence[str], turns: int
) -> DataFrame:
    """``names`` and ``_quota`` of every stratum."""
    more = also.withColumn("_more", F.lit(1))
    return sizes.join(more, _same(strata, names), "left").select(
        *[F.col(s).alias(f"{name}q") for s, name in zip(strata, names)],
        (F.least("_size", F.lit(turns)) + F.coalesce("_more", F.lit(0))).alias("_quota")
    ).withColumnsRenamed({f"{name}q": name for name in names})


def _by_prefix(
    ordered: DataFrame, quotas: DataFrame, strata: Sequence[str], names: Sequence[str], row_id: str
) -> DataFrame:
    """The first rows of every stratum, as many as its quota.

    Earlier prefixes of the order are taken whole, and only rows of the prefix that holds the cut are
    put in order.
    """
    held = stored(ordered, "strata")
    prefix = F.substring("_order", 1, _PREFIX_DIGITS)
    parts = held.groupBy(*strata, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows"))
    # At most 16^4 prefixes of a stratum meet in this window.
    upto = F.sum("_rows").over(Window.partitionBy(*strata).orderBy("_prefix"))
    cuts = (
        parts.withColumn("_upto", upto).join(quotas, _same(strata, names))
        .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_rows") < F.col("_quota")))
        .select(*names, F.col("_prefix").alias("_cut"),
                (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("_last")))
    rows = held.join(cuts, _same(strata, names)).where(prefix <= F.col("_cut"))
    inner = Window.partitionBy(*strata).orderBy("_order", row_id)
    at_cut = rows.where(prefix == F.col("_cut")).withColumn("_turn", F.row_number().over(inner)).where(
        F.col("_turn") <= F.col("_last"))
    return rows.where(prefix < F.col("_cut")).unionByName(at_cut.drop("_turn"))
