import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from calibrant.operators import sampling as S


def digest(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.mark.parametrize("partitions", [1, 5, 13])
def test_row_index_is_dense_and_ordered(spark, partitions):
    df = spark.range(1000).select((F.col("id") % 3).alias("season"), "id").repartition(7)
    rows = S.with_row_index(df, ["season", "id"], partitions).collect()
    ordered = sorted(rows, key=lambda r: (r["season"], r["id"]))
    assert [r["row_index"] for r in ordered] == list(range(1000))


def test_stride_keeps_every_nth(spark):
    df = spark.range(101).select((100 - F.col("id")).alias("id")).repartition(5)
    assert sorted(r["id"] for r in S.stride_sample(df, 8, ["id"]).collect()) == list(range(0, 101, 8))
    assert S.stride_sample(df, 1, ["id"]) is df
    indexed = spark.range(50).select("id", F.col("id").alias("pos"))
    assert S.stride_sample(indexed, 20, [], index="pos").count() == 3


@pytest.mark.parametrize("n", [1, 37, 200, 999])
def test_seeded_sample_is_exact_and_stable(spark, n):
    expected = sorted(range(200), key=lambda i: digest(7, i))[:n]
    for partitions in (1, 6):
        df = spark.range(200).withColumnRenamed("id", "row_id").repartition(partitions)
        got = S.seeded_sample_n(df, n, "row_id", 7).collect()
        assert sorted(r["row_id"] for r in got) == sorted(expected)


@pytest.mark.parametrize("n", [1, 10, 22, 23, 30])
def test_seeded_sample_with_unknown_ids(spark, n):
    """NULL ids are drawn like the id that is the empty text; repeated ids like any other."""
    rows = [(i if i > 2 else None, i) for i in range(20)] + [(5, 99)] * 3
    df = spark.createDataFrame(rows, "row_id long, v int")
    got = sorted(r["v"] for r in S.seeded_sample_n(df, n, "row_id", 3).collect())
    assert len(got) == min(n, 23)
    order = sorted(rows, key=lambda r: digest(3, "" if r[0] is None else r[0]))
    last = digest(3, "" if order[min(n, 23) - 1][0] is None else order[min(n, 23) - 1][0])
    sure = [v for i, v in rows if digest(3, "" if i is None else i) < last]
    for v in set(sure):
        assert got.count(v) == sure.count(v)


def test_large_samples(spark):
    df = spark.range(1_200_000).withColumnRenamed("id", "row_id")
    got = S.seeded_sample_n(df, 1_000_000, "row_id", 5)
    assert got.count() == got.distinct().count() == 1_000_000
    first = S.take_first_n(df, 1_000_000, ["row_id"]).agg(F.count("*"), F.max("row_id")).first()
    assert tuple(first) == (1_000_000, 999_999)
    strata = df.withColumn("s", F.when(F.col("row_id") % 3 > 0, "hot").otherwise("cold"))
    sizes = S.stratified_sample(strata, 1_000_000, ["s"], "row_id", 0).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in sizes} == {"hot": 600_000, "cold": 400_000}


def test_first_n(spark):
    df = spark.range(20).repartition(4)
    assert sorted(r["id"] for r in S.take_first_n(df, 3, ["id"]).collect()) == [0, 1, 2]
    assert S.take_first_n(df, 0, ["id"]).count() == 20


def test_a_million_strata(spark):
    """None of them comes to the driver; the largest strata, then the smallest keys, give the rest."""
    df = spark.range(1_000_000).select(F.col("id").alias("row_id"), F.col("id").alias("s")).union(
        spark.range(40).select(F.col("id") + 2_000_000, F.col("id") % 4))
    got = S.stratified_sample(df, 1000, ["s"], "row_id", 0)
    found = sorted(r["s"] for r in got.select("s").collect())
    assert found == list(range(1000))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "TakeOrdered" not in plan


def test_turns(spark):
    sizes = spark.createDataFrame([(5,), (3,), (1,)], "_size long")
    assert [S._turns(sizes, n) for n in (1, 3, 4, 5, 7, 8, 9, 10)] == [
        (0, 1), (1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (-1, 0), (-1, 0)]


@pytest.mark.parametrize("most_turns", [1000, 1])
@pytest.mark.parametrize("n", [1, 10, 40, 89, 500])
def test_stratified_round_robin(spark, n, most_turns, monkeypatch):
    monkeypatch.setattr(S, "_MOST_TURNS", most_turns)
    # One stratum holds two thirds of the rows, one is NULL, some are single rows.
    rows = [(i, "hot" if i < 60 else (None if i < 70 else f"s{i % 9}")) for i in range(90)]
    groups = defaultdict(list)
    for i, s in rows:
        groups[s].append(i)
    for members in groups.values():
        members.sort(key=lambda i: digest(0, i))
    order = sorted(groups, key=lambda s: (-len(groups[s]), s is not None, s))
    expected, turn = [], 0
    while len(expected) < min(n, len(rows)):
        for s in order:
            if turn < len(groups[s]) and len(expected) < n:
                expected.append(groups[s][turn])
        turn += 1
    df = spark.createDataFrame(rows, "row_id long, s string").repartition(5)
    got = S.stratified_sample(df, n, ["s"], "row_id", 0).collect()
    assert sorted(r["row_id"] for r in got) == sorted(expected)
