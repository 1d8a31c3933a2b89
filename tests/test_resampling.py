import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.operators import resampling as R
from calibrant.operators.calibration import score


def whole_percents(n=400, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, 101, n) / 100
    return p, (rng.uniform(size=n) < p).astype(int)


def frame(spark, p, y, variant="m"):
    rows = [(variant, i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))]
    return spark.createDataFrame(rows, "variant string, row_id long, prob double, outcome int")


def ece(p, y):
    bins = np.digitize(p, np.linspace(0, 1, 11)[1:-1])
    return sum(abs(p[bins == b].sum() - y[bins == b].sum()) for b in range(10)) / len(p)


def brute_interval(p, y, reps=4000):
    rng = np.random.default_rng(1)
    picks = [rng.integers(0, len(p), len(p)) for _ in range(reps)]
    brier = [((p[i] - y[i]) ** 2).mean() for i in picks]
    gap = [ece(p[i], y[i]) for i in picks]
    return np.percentile(brier, [2.5, 97.5]), np.percentile(gap, [2.5, 97.5])


@pytest.mark.parametrize("continuous", [False, True])
def test_intervals_agree_with_plain_resampling(spark, continuous):
    p, y = whole_percents()
    if continuous:
        p = np.clip(p + np.random.default_rng(9).uniform(-0.004, 0.004, len(p)), 0, 1)
    brier, gap = brute_interval(p, y)
    row = R.bootstrap_ci(frame(spark, p, y), reps=4000).first()
    width = brier[1] - brier[0]
    assert row["brier_lo"] == pytest.approx(brier[0], abs=0.08 * width)
    assert row["brier_hi"] == pytest.approx(brier[1], abs=0.08 * width)
    width = gap[1] - gap[0]
    assert row["ece_lo"] == pytest.approx(gap[0], abs=0.1 * width)
    assert row["ece_hi"] == pytest.approx(gap[1], abs=0.1 * width)


def test_draws_do_not_depend_on_partitions(spark):
    df = frame(spark, *whole_percents(120)).unionByName(frame(spark, *whole_percents(80, 3), "n"))
    results = [
        {r["variant"]: r for r in R.bootstrap_ci(
            df.repartition(k), reps=100).collect()} for k in (1, 6)]
    for variant in ("m", "n"):
        for name in ("brier_lo", "brier_hi", "ece_lo", "ece_hi"):
            assert results[0][variant][name] == pytest.approx(results[1][variant][name], abs=1e-12)
    other = R.bootstrap_ci(df, reps=100, seed=5).where("variant = 'm'").first()
    assert other["brier_lo"] != results[0]["m"]["brier_lo"]


def test_weights_follow_from_the_bucket(spark):
    """Plain integer arithmetic, row by row."""
    df = spark.createDataFrame([("m", i, 1.0) for i in range(30)], "g string, row_id long, x double")
    got = {r["rep"]: r for r in R.replicate_sums(df, ["g"], ["x"], reps=12, seed=3).collect()}
    start = int(hashlib.md5(b"3").hexdigest()[:8], 16)
    assert got[-1]["weight"] == 30
    for rep in range(12):
        total = 0
        for i in range(30):
            bucket = int(hashlib.md5(f"3|{i}".encode()).hexdigest()[:8], 16) % 1024
            x = (start + 1024 * rep + bucket) % 2**32
            x = (x ^ x >> 16) * 0x7FEB352D % 2**32
            x = (x ^ x >> 15) * 0x846CA68B % 2**32
            total += sum((x ^ x >> 16) >= step for step in R.POISSON_STEPS)
        assert got[rep]["weight"] == got[rep]["x"] == total


def test_weight_law_is_poisson_one():
    mass = np.diff([0, *R.POISSON_STEPS, 2**32]) / 2**32
    for k in range(10):
        assert mass[k] == pytest.approx(np.exp(-1) / math.factorial(k), abs=1e-9)
    weights = R.bucket_weights(4000, 0)[1:]
    assert weights.mean() == pytest.approx(1, abs=2e-3)
    assert weights.var() == pytest.approx(1, abs=4e-3)
    # Replicates and buckets are independent of each other.
    assert abs(np.corrcoef(weights[0], weights[1])[0, 1]) < 0.12
    assert weights.sum(axis=1).var() == pytest.approx(R.BUCKETS, rel=0.1)
    assert weights.sum(axis=0).var() == pytest.approx(4000, rel=0.2)


def test_large_groups_have_the_spread_of_rows(spark):
    """Far more rows than buckets: the interval is that of a mean of independent rows."""
    df = spark.range(60_000).select(
        F.lit("g").alias("g"), F.col("id").alias("row_id"),
        (F.xxhash64("id") % 1000 / 1000.0).alias("x"))
    row = R.mean_ci(df, ["g"], "x").first()
    spread = df.agg(F.stddev("x")).first()[0]
    assert row["hi"] - row["lo"] == pytest.approx(2 * 1.96 * spread / 60_000**0.5, rel=0.12)


def test_many_groups(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 10_000).alias("g"), F.col("id").alias("row_id"), F.lit(1.0).alias("x"))
    got = R.mean_ci(df, ["g"], "x", reps=50)
    assert got.count() == 10_000
    assert got.where("mean != 1 or lo != 1 or hi != 1 or n != 3").count() == 0


def test_unknown_outcomes_do_not_count(spark):
    """The interval holds the estimate that ``score`` gives for the same rows."""
    p, y = whole_percents(500, 7)
    df = frame(spark, p, y).withColumn(
        "outcome", F.when(F.col("row_id") % 5 != 0, F.col("outcome")))
    row, scored = R.bootstrap_ci(df, reps=500).first(), score(df, ["brier", "ece"]).first()
    assert row["brier"] == pytest.approx(scored["brier"])
    assert row["ece"] == pytest.approx(scored["ece"])
    assert row["brier_lo"] < row["brier"] < row["brier_hi"]


def test_clear_and_unclear_differences(spark):
    rng = np.random.default_rng(0)
    clear = [("clear", i, float(v)) for i, v in enumerate(rng.normal(0.02, 0.005, 300))]
    none = [("none", i, float(v)) for i, v in enumerate(np.random.default_rng(1).normal(0, 0.02, 400))]
    df = spark.createDataFrame(clear + none, "g string, row_id long, d double")
    got = {r["g"]: r for r in R.mean_ci(df, ["g"], "d", reps=1000).collect()}
    assert got["clear"]["mean"] == pytest.approx(0.02, abs=0.003) and got["clear"]["lo"] > 0
    assert got["clear"]["significant"] and not got["none"]["significant"]
    assert got["none"]["lo"] < 0 < got["none"]["hi"]


def test_paired_bootstrap_keeps_the_pairing(spark):
    rng = np.random.default_rng(2)
    n = 300
    y = rng.integers(0, 2, n)
    a = np.clip(0.5 + (y - 0.5) * 0.5 + rng.normal(0, 0.1, n), 0, 1).round(2)
    b = np.clip(a + (0.5 - y) * 0.1, 0, 1).round(2)
    market = rng.integers(0, 101, n) / 100
    df = spark.createDataFrame(
        [(i, float(a[i]), float(b[i]), float(market[i]), int(y[i])) for i in range(n)],
        "row_id long, a double, b double, market double, outcome int")
    diff = (a - y) ** 2 - (b - y) ** 2
    picks = np.random.default_rng(0).integers(0, n, (4000, n))
    lo, hi = np.percentile(diff[picks].mean(axis=1), [2.5, 97.5])
    rows = {(r["metric"], r["pair"]): r for r in R.paired_bootstrap(df).collect()}
    row = rows["brier", "a - b"]
    assert len(rows) == 6 and row["n"] == n
    assert row["mean"] == pytest.approx(diff.mean())
    assert row["lo"] == pytest.approx(lo, abs=0.12 * (hi - lo))
    assert row["hi"] == pytest.approx(hi, abs=0.12 * (hi - lo))
    assert row["significant"] and row["hi"] < 0


def test_proportions(spark):
    rows = [("a", i, i < 30) for i in range(100)] + [("b", i, False) for i in range(50)] + [
        ("c", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, row_id long, hit boolean")
    flags = {"hit": F.col("hit"), "miss": ~F.col("hit")}
    got = {(r["g"], r["category"]): r for r in R.proportion_ci(df, ["g"], flags, 4000).collect()}
    drawn = np.repeat([1.0, 0.0], [30, 70])
    means = drawn[np.random.default_rng(0).integers(0, 100, (4000, 100))].mean(axis=1)
    lo, hi = np.percentile(means, [2.5, 97.5])
    assert got["a", "hit"]["rate"] == pytest.approx(0.3)
    assert got["a", "miss"]["rate"] == pytest.approx(0.7)
    assert got["a", "hit"]["lo"] == pytest.approx(lo, abs=0.02)
    assert got["a", "hit"]["hi"] == pytest.approx(hi, abs=0.02)
    assert [got["b", "hit"][k] for k in ("n", "rate", "lo", "hi")] == [50, 0, 0, 0]
    assert [got["c", "hit"][k] for k in ("n", "rate")] == [5, 0]


def test_any_statistic_of_weighted_sums(spark):
    p, y = whole_percents(300, 4)
    q = np.clip(p, 0.01, 0.99)
    losses = -(y * np.log(q) + (1 - y) * np.log(1 - q))
    picks = np.random.default_rng(0).integers(0, 300, (4000, 300))
    lo, hi = np.percentile(losses[picks].mean(axis=1), [2.5, 97.5])
    clip = F.greatest(F.least("prob", F.lit(0.99)), F.lit(0.01))
    loss = -F.when(F.col("outcome") == 1, F.ln(clip)).otherwise(F.ln(1 - clip))
    row = R.bootstrap_statistics(
        frame(spark, p, y), ["variant"], {"loss": loss},
        {"log_loss": F.sum("loss") / F.sum("weight")}, reps=2000).first()
    assert row["log_loss"] == pytest.approx(losses.mean())
    assert row["log_loss_lo"] == pytest.approx(lo, abs=0.1 * (hi - lo))
    assert row["log_loss_hi"] == pytest.approx(hi, abs=0.1 * (hi - lo))


def test_median(spark):
    values = np.random.default_rng(3).integers(0, 60, 301)
    df = spark.createDataFrame([("g", i, int(v)) for i, v in enumerate(values)],
                               "g string, row_id long, v long")
    median = F.percentile("v", F.lit(0.5), F.col("weight").cast("bigint"))
    row = R.bootstrap_statistics(df, ["g"], {}, {"median": median}, {"v": F.col("v")}).first()
    picks = np.random.default_rng(0).integers(0, 301, (4000, 301))
    lo, hi = np.percentile(np.median(values[picks], axis=1), [2.5, 97.5])
    assert row["median"] == np.median(values)
    assert row["median_lo"] == pytest.approx(lo, abs=1) and row["median_hi"] == pytest.approx(hi, abs=1)


def test_estimates_are_of_the_data(spark):
    p, y = whole_percents(200, 5)
    row = R.bootstrap_ci(frame(spark, p, y), reps=20).first()
    assert row["brier"] == pytest.approx(((p - y) ** 2).mean())
    assert row["ece"] == pytest.approx(ece(p, y))


def test_rows_without_an_id_are_refused(spark):
    rows = [("a", None, 0.25, 1), ("a", None, 0.5, 0), ("b", 1, 0.5, 1)]
    df = spark.createDataFrame(rows, "variant string, row_id long, prob double, outcome int")
    with pytest.raises(Exception, match="row_id is NULL"):
        R.bootstrap_ci(df, reps=50).collect()
