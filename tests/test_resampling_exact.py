"""Draws of exactly n rows and quantiles from sketches, against plain resampling of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.operators import resampling_exact as X


def frame(spark, values, groups=1):
    rows = [(i, f"g{i % groups}" if i % groups else None, float(x)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "row_id long, g string, x double")


def test_replicates_draw_exactly_n(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.integers(0, 40, 3000), 3).withColumn("bin", F.col("x") % 4)
    sums = X.multinomial_sums(df, ["g"], ["x"], ["bin"], reps=200, part_cells=4)
    weights = sums.groupBy("g", "rep").agg(F.sum("weight").alias("w")).collect()
    assert len(weights) == 3 * 201 and {r["w"] for r in weights} == {1000.0}
    data = {r["g"]: r["x"] for r in sums.where("rep = -1").groupBy("g").agg(F.sum("x").alias("x")).collect()}
    own = {r["g"]: r["x"] for r in df.groupBy("g").agg(F.sum("x").alias("x")).collect()}
    assert data == own


def test_draws_do_not_depend_on_partitioning(spark):
    df = frame(spark, np.random.default_rng(2).integers(0, 99, 800), 2)
    one, two = (sorted(map(tuple, X.multinomial_sums(d, ["g"], ["x"], reps=50, part_cells=16).collect()), key=repr)
                for d in (df, df.repartition(7)))
    assert one == two


@pytest.mark.parametrize("part_cells", [4096, 64])
def test_width_is_that_of_row_resampling(spark, part_cells):
    """Means over many seeds: the spread of 4000 replicates agrees with sigma / sqrt(n)."""
    values = np.random.default_rng(3).normal(size=1500).round(3)
    sums = X.multinomial_sums(frame(spark, values), [], ["x"], reps=20_000, seed=5, part_cells=part_cells)
    means = np.array([r["x"] / r["weight"] for r in sums.where("rep >= 0").select("x", "weight").collect()])
    assert len(means) == 20_000
    # 20 000 replicates know the spread to 0.5 percent.
    assert abs(means.std() / (values.std() / np.sqrt(len(values))) - 1) < 0.02
    assert abs(means.mean() - values.mean()) < 4 * values.std() / np.sqrt(len(values)) / np.sqrt(20_000)


def test_exact_intervals_next_to_row_resampling(spark):
    rng = np.random.default_rng(4)
    p = rng.integers(0, 101, 900) / 100
    y = (rng.random(900) < p).astype(int)
    df = spark.createDataFrame([("v", float(a), int(b)) for a, b in zip(p, y)], "variant string, prob double, outcome int")
    row = X.exact_bootstrap_ci(df, reps=4000).first()
    error = (p - y) ** 2
    drawn = np.array([error[rng.integers(0, 900, 900)].mean() for _ in range(4000)])
    lo, hi = np.percentile(drawn, [2.5, 97.5])
    assert row["brier"] == pytest.approx(error.mean())
    assert abs((row["brier_hi"] - row["brier_lo"]) / (hi - lo) - 1) < 0.06
    assert row["brier_lo"] == pytest.approx(lo, abs=0.1 * (hi - lo))


def test_quantiles_of_few_values_are_exact(spark):
    values = np.random.default_rng(5).integers(0, 60, 2000)
    got = X.quantile_intervals(frame(spark, values, 2), ["g"], "x", (0.25, 0.5, 0.9), reps=300).collect()
    for r in got:
        mine = [x for i, x in enumerate(values) if (i % 2 == 0) == (r["g"] is None)]
        assert r["n"] == 1000 and r["estimate"] == pytest.approx(np.quantile(mine, r["quantile"]))
        assert r["lo"] <= r["estimate"] <= r["hi"]
    assert len(got) == 6


def test_quantiles_of_a_million_values(spark):
    """Distinct values: the error is a small part of the interval, and no (value, replicate) rows exist."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * 7919 % n).cast("double").alias("x"))
    got = {r["quantile"]: r for r in X.quantile_intervals(df, [], "x", (0.25, 0.5, 0.75)).collect()}
    for q, r in got.items():
        width = 2 * 1.96 * np.sqrt(q * (1 - q) * n)   # of the interval of row resampling, in values
        assert r["n"] == n and abs(r["estimate"] - q * (n - 1)) < 0.03 * width
        assert abs((r["hi"] - r["lo"]) / width - 1) < 0.12   # buckets leave 3.4 percent, 2000 replicates 3 percent


def test_empty_and_unknown(spark):
    df = frame(spark, [1.0, 2.0])
    assert X.quantile_intervals(df.where("false"), ["g"], "x").collect() == []
    assert X.multinomial_sums(df.where("false"), ["g"], ["x"], reps=5).collect() == []
    with pytest.raises(Exception, match="row_id is NULL"):
        X.quantile_intervals(df.withColumn("row_id", F.lit(None).cast("long")), ["g"], "x").collect()
