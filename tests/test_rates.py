from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.operators.rates import (
    RateKey, Target, backoff_lookup, coarser, longest_prefixes, rate_table, state_keys,
)

NAMES = ["a", "b", "c"]


def rows_of(seed, n, values):
    rng = np.random.default_rng(seed)
    keys = [rng.integers(0, v, n).tolist() for v in values]
    # A third of all rows in one state.
    hot = rng.uniform(size=n) < 0.33
    table = [[0 if h else k for k, h in zip(column, hot)] for column in keys]
    y = rng.integers(0, 2, n).tolist()
    return [(i, *(c[i] for c in table), y[i]) for i in range(n)]


def brute(rows, m=25.0):
    counts = [defaultdict(lambda: [0, 0]) for _ in range(4)]
    for _, *key, y in rows:
        for depth in range(4):
            cell = counts[depth][tuple(key[:depth])]
            cell[0] += y
            cell[1] += 1
    rate = [{(): counts[0][()][0] / counts[0][()][1]}]
    for depth in range(1, 4):
        rate.append({k: (w + m * rate[depth - 1][k[:-1]]) / (n + m)
                     for k, (w, n) in counts[depth].items()})
    return counts, rate


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, a int, b int, c int, outcome int")


def test_table_and_backoff(spark):
    keys = [RateKey(n, F.col(n)) for n in NAMES]
    train, held_out = rows_of(1, 600, (4, 5, 6)), rows_of(2, 300, (5, 7, 12))
    counts, rate = brute(train)
    table = rate_table(frame(spark, train), keys)
    got = {(r["level"], tuple(r[n] for n in NAMES[:r["level"]])): r for r in table.collect()}
    assert len(got) == sum(len(c) for c in counts)
    for depth in range(4):
        for key, value in rate[depth].items():
            row = got[depth, key]
            assert row["phat"] == pytest.approx(value, abs=1e-12)
            assert [row["wins"], row["n"]] == counts[depth][key]
    looked = backoff_lookup(frame(spark, held_out), table, keys).collect()
    assert len(looked) == len(held_out)
    by_id = {r["row_id"]: r for r in looked}
    depths = set()
    for i, *key, _ in held_out:
        depth = max(d for d in range(4) if tuple(key[:d]) in rate[d])
        depths.add(depth)
        assert by_id[i]["phat"] == pytest.approx(rate[depth][tuple(key[:depth])], abs=1e-12)
        assert by_id[i]["phat_level"] == depth
    assert depths == {0, 1, 2, 3}


def test_null_keys_are_states(spark):
    keys = [RateKey("a", F.col("a"))]
    train = frame(spark, [(0, None, 0, 0, 1), (1, None, 0, 0, 1), (2, 1, 0, 0, 0)])
    table = rate_table(train, keys, m=1.0)
    looked = {r["a"]: r for r in backoff_lookup(
        frame(spark, [(5, None, 0, 0, 0), (6, 1, 0, 0, 0), (7, 9, 0, 0, 0)]), table, keys).collect()}
    overall = 2 / 3
    assert looked[None]["phat"] == pytest.approx((2 + overall) / 3)
    assert looked[1]["phat"] == pytest.approx(overall / 2)
    assert (looked[9]["phat"], looked[9]["phat_level"]) == (pytest.approx(overall), 0)


def test_coarser_is_the_table_of_fewer_keys(spark):
    keys = [RateKey(n, F.col(n)) for n in NAMES]
    df = frame(spark, rows_of(4, 200, (3, 3, 3)))
    fine = coarser(rate_table(df, keys), keys[:2])
    own = rate_table(df, keys[:2])
    pick = lambda d: sorted(map(str, d.withColumn("phat", F.round("phat", 12)).collect()))
    assert pick(fine) == pick(own)


def test_rounding_is_half_even_on_the_stored_value(spark):
    keys = [RateKey("a", F.col("a"))]
    df = frame(spark, rows_of(6, 97, (3, 1, 1)))
    table = rate_table(df, keys)
    exact = {r["row_id"]: r["phat"] for r in backoff_lookup(df, table, keys).collect()}
    for r in backoff_lookup(df, table, keys, decimals=5).collect():
        assert r["phat"] == round(exact[r["row_id"]], 5)


def test_keys_are_compared_by_value(spark):
    """-0.0 is 0.0, NaN is NaN, and no text is taken for NULL."""
    schema = "row_id long, x double, t string, outcome int"
    train = spark.createDataFrame(
        [(0, 0.0, "\u0000", 1), (1, 0.0, "\u0000", 1), (2, 1.0, None, 0), (3, float("nan"), "", 0)],
        schema)
    for key, rows in (("x", [(0, -0.0), (1, 1.0), (2, float("nan")), (3, 2.0)]),
                      ("t", [(0, "\u0000"), (1, None), (2, ""), (3, "new")])):
        keys = [RateKey(key, F.col(key))]
        asked = spark.createDataFrame(rows, f"row_id long, {key} {dict(train.dtypes)[key]}")
        got = {r["row_id"]: r["phat_level"]
               for r in backoff_lookup(asked, rate_table(train, keys), keys).collect()}
        assert got == {0: 1, 1: 1, 2: 1, 3: 0}


def test_as_many_states_as_rows(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("row_id"), F.concat(F.lit("k"), "id").alias("a"),
        (F.col("id") % 2).cast("int").alias("outcome"))
    keys = [RateKey("a", F.col("a"))]
    got = backoff_lookup(df, rate_table(df, keys), keys)
    assert got.count() == 20_000
    assert got.where("phat_level != 1 OR abs(phat - (outcome + 12.5D) / 26D) > 1e-12").count() == 0


def test_rows_without_outcome_teach_nothing(spark):
    keys = [RateKey("a", F.col("a"))]
    df = frame(spark, [(0, 1, 0, 0, 1), (1, 1, 0, 0, None), (2, 2, 0, 0, None)])
    assert [(r["level"], r["n"]) for r in rate_table(df, keys).orderBy("level").collect()] == [
        (0, 1), (1, 1)]


def test_unknown_downs_are_null(spark):
    key = state_keys(F.lit(0), F.lit(0), F.lit(0.0), F.lit(50), F.col("id"))[-1]
    got = spark.range(8, 12).select(key.column).collect()
    assert [r[0] for r in got] == [8, 9, None, None]


@pytest.mark.parametrize("most_rows", [1 << 18, 0])
def test_many_targets_together(spark, most_rows):
    """Both ways give what one look-up per target gives; within the bound the rows are scanned once."""
    rows = [(i, i % 5 if i % 7 else None, (-0.0 if i % 2 else 0.0) if i % 3 else 1.5, "x" if i % 4 else "1:y", i % 2)
            for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a int, b double, c string, outcome int")
    fine = [RateKey("ka", F.col("a")), RateKey("kb", F.col("b")), RateKey("kc", F.col("c"))]
    other = [RateKey("kc", F.col("c")), RateKey("ka", F.col("a") + 1)]
    train = df.where("row_id < 60")
    targets = [Target("fine", rate_table(train, fine), fine), Target("other", rate_table(train, other), other),
               Target("none", rate_table(train, []), [])]
    asked = df.union(spark.createDataFrame([(900, 77, 2.0, "new", 0), (901, None, None, None, 1)], df.schema))
    got = {r["row_id"]: r for r in longest_prefixes(asked, targets, most_rows=most_rows).collect()}
    assert len(got) == 402
    for target in targets:
        table = {}
        for r in target.table.collect():
            key = tuple(None if r[k.name] is None else r[k.name] + 0.0 if isinstance(r[k.name], float) else r[k.name]
                        for k in target.keys[:r["level"]])
            table[key] = r["phat"]
        for i, a, b, c, _ in rows + [(900, 77, 2.0, "new", 0), (901, None, None, None, 1)]:
            b = None if b is None else b + 0.0
            state = {"fine": (a, b, c), "other": (c, None if a is None else a + 1), "none": ()}[target.name]
            depth = max(d for d in range(len(state) + 1) if state[:d] in table)
            assert got[i][target.name] == table[state[:depth]] and got[i][f"{target.name}_level"] == depth


def test_one_scan_for_any_number_of_targets(spark, tmp_path):
    spark.range(500).select(
        "id", (F.col("id") % 3).alias("a"), (F.col("id") % 2).cast("int").alias("outcome")
    ).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    keys = [RateKey("ka", F.col("a"))]
    table = rate_table(df, keys)
    for n in (1, 2, 4):
        looked = longest_prefixes(df, [Target(f"t{i}", table, keys) for i in range(n)])
        plan = looked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("tmp_path") + plan.count(str(tmp_path / "rows")) == 1
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
