"""Rank selection against sorting, with ties, NULLs, equal rows and every type of digit."""

import datetime
import decimal
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from calibrant.operators import ranks as R
from calibrant.operators.sampling import stride_sample, take_first_n

SCHEMA = "i int, s string, d double, day date, at timestamp, m decimal(9,2), b boolean, raw binary, x long"


def made(seed, n):
    draw = random.Random(seed)
    texts = ["", "a", "a\0", "ab", "abcdefg", "abcdefgh", "abcdefg\0", "é", "日本語テキスト", "z" * 40, "z" * 39 + "y", None]
    doubles = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e-310, -2.5, 1e308, -1e308, 0.1, 0.1 + 1e-17]
    day = datetime.date(1960, 1, 1)
    rows = []
    for _ in range(n):
        shift = datetime.timedelta(days=draw.randint(0, 9))
        rows.append((
            draw.choice([None, -2**31, 2**31 - 1, 0, 1, 2]), draw.choice(texts), draw.choice(doubles), day + shift,
            datetime.datetime(1969, 12, 31) + shift, draw.choice([None, decimal.Decimal("-1.25"), decimal.Decimal("3.00")]),
            draw.choice([None, True, False]), draw.choice([None, b"", b"\xff\x00", b"\xff"]),
            draw.choice([-2**63, 2**63 - 1, 5, 5, 5])))
    return rows


def key(value):
    """Spark's order: NULL first, NaN last, texts by bytes."""
    if value is None:
        return (0, 0)
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytearray):
        value = bytes(value)
    if isinstance(value, float):
        return (2, 0) if math.isnan(value) else (1, value + 0.0)
    return (1, value)


def keys(rows, columns):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return [tuple(key(row[names.index(c)]) for c in columns) for row in rows]


def frozen(row):
    return repr(tuple(row))


ORDERS = [["s", "i"], ["d", "x", "m"], ["b", "raw", "day", "at"]]


@pytest.mark.parametrize("order", ORDERS)
def test_ranks_of_odd_values(spark, order):
    rows = made(3, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    held = Counter(frozen(row) for row in df.collect())
    ordered = sorted(keys(rows, order))
    for rule, wanted in ((R.first(131), ordered[:131]), (R.every(7), ordered[::7])):
        got = R.select_ranks(df, order, rule, leaf_rows=9, buckets=200).collect()
        assert sorted(keys(got, order)) == wanted
        assert not Counter(frozen(row) for row in got) - held  # rows of the table, no more copies than it has


@pytest.mark.parametrize("n", [5, 250, 1001])
def test_first_n_with_ties_is_exact(spark, n):
    df = spark.range(1000).select((F.col("id") % 4).alias("season"), "id").repartition(6)
    got = take_first_n(df, n, ["season"]).collect()
    assert sorted(r["season"] for r in got) == sorted(i % 4 for i in range(1000))[:n]
    assert len({r["id"] for r in got}) == len(got)


@pytest.mark.parametrize("stride", [8, 333, 5000])
def test_stride_with_ties_is_exact(spark, stride):
    df = spark.range(1000).select((F.col("id") % 4).alias("season"), "id")
    assert stride_sample(df, stride, ["season"]).count() == math.ceil(1000 / stride)


def test_equal_rows_are_counted_not_ordered(spark):
    df = spark.range(90_000).select(F.lit("same").alias("s"), F.lit(1).alias("x")).union(
        spark.range(10_000).select(F.lit("zz").alias("s"), F.col("id").cast("int").alias("x")))
    search = R._Search(df, ["s"], R.every(3), 1000, 512)
    assert {leaf.state for leaf in search.run()} >= {"equal"}
    got = R.select_ranks(df, ["s"], R.every(3), 1000, 512)
    assert got.count() == 33_334 and got.where("s = 'same'").count() == 30_000
    assert R.select_ranks(df, ["s"], R.first(70_001), 1000, 512).where("s = 'same'").count() == 70_001


def test_same_rows_for_every_partitioning(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.col("id") * 31 % 1009).alias("v"), "id")
    wanted = sorted(r["id"] for r in R.select_ranks(df, ["k"], R.every(11), 50, 64).collect())
    for parts in (1, 7):
        got = R.select_ranks(df.repartition(parts), ["k"], R.every(11), 50, 64).collect()
        assert sorted(r["id"] for r in got) == wanted


def test_columns_without_digits(spark):
    df = spark.range(500).select(F.array(F.col("id") % 50).alias("a"), "id", F.create_map(F.lit("k"), "id").alias("m"))
    got = R.select_ranks(df, ["a", "id"], R.first(33), 10, 64)
    assert got.count() == 33 and got.agg(F.max(F.col("a")[0])).first()[0] == 3


def test_empty_table(spark):
    df = spark.range(0)
    assert take_first_n(df, 3, ["id"]).columns == ["id"] and take_first_n(df, 3, ["id"]).count() == 0
    assert stride_sample(df, 3, ["id"]).count() == 0


def test_few_rows_are_shuffled_for_the_first_ones(spark):
    """128 of two million: only the range with the cut is put in order."""
    df = spark.range(2_000_000).select((F.col("id") * 7919 % 2_000_003).alias("k"))
    search = R._Search(df, ["k"], R.first(128), 1000, 4096)
    leaves = search.run()
    assert sum(leaf.count for leaf in leaves if leaf.state == "sort") <= 1000
    assert len(search.levels) <= 2 and take_first_n(df, 128, ["k"]).count() == 128
    plan = take_first_n(df, 128, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "InMemory" not in plan
