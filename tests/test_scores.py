import numpy as np
import pytest
from pyspark.sql import functions as F

from calibrant.functions.scoring import calibration_bin, score_reward, score_reward_fn
from calibrant.operators.staging import reward_stage
from calibrant.operators import calibration as C
from calibrant.operators import cleaning, telemetry
from calibrant.sources.records import write_split_jsonl


def forecasts(spark, p, y, variant="m"):
    return spark.createDataFrame(
        [(variant, None if a is None else float(a), int(b)) for a, b in zip(p, y)],
        "variant string, prob double, outcome int")


def brute(p, y, n_bins=10):
    p, y = np.asarray(p, float), np.asarray(y, float)
    bins = np.digitize(p, np.linspace(0, 1, n_bins + 1)[1:-1])
    base, out = y.mean(), dict(ece=0.0, mce=0.0, reliability=0.0, resolution=0.0)
    for b in range(n_bins):
        inside = bins == b
        if inside.any():
            share, gap = inside.mean(), abs(p[inside].mean() - y[inside].mean())
            out["ece"] += share * gap
            out["mce"] = max(out["mce"], gap)
            out["reliability"] += share * gap ** 2
            out["resolution"] += share * (y[inside].mean() - base) ** 2
    q = np.clip(p, 1e-12, 1 - 1e-12)
    return dict(out, brier=((p - y) ** 2).mean(), uncertainty=base * (1 - base),
                log_loss=-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean(),
                accuracy=((p > 0.5) == (y == 1)).mean())


@pytest.mark.parametrize("partitions", [1, 7])
def test_metrics_match_brute_force(spark, partitions):
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(0, 1, 800), [0.0, 1.0, 0.5, 0.3, 0.6, 0.7]])
    y = (rng.uniform(0, 1, len(p)) < p).astype(int)
    row = C.score(forecasts(spark, p, y).repartition(partitions)).first().asDict()
    for name, value in brute(p, y).items():
        assert row[name] == pytest.approx(value, abs=1e-12), name
    assert row["brier_check"] == pytest.approx(row["brier"], abs=0.02)


def test_calibrated_is_low_and_overconfident_is_high(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 1, 5000)
    good = forecasts(spark, p, rng.uniform(0, 1, 5000) < p, "good")
    bad = forecasts(spark, np.full(1000, 0.99), np.tile([1, 0], 500), "bad")
    ece = {r["variant"]: r["ece"] for r in C.score(good.union(bad), ["ece"]).collect()}
    assert ece["good"] < 0.05 and ece["bad"] > 0.4


def test_binning_rules_differ_where_the_grid_is_inexact(spark):
    df = spark.createDataFrame([(0.3,), (0.6,), (0.7,), (0.5,), (1.0,), (0.0,), (None,)], "p double")
    rows = df.select(calibration_bin(F.col("p")), calibration_bin(F.col("p"), rule="floor")).collect()
    assert [r[0] for r in rows][:6] == [2, 5, 6, 5, 9, 0]
    assert [r[1] for r in rows][:6] == [3, 6, 7, 5, 9, 0]


def test_curve_has_every_bin(spark):
    curve = C.reliability_curve(forecasts(spark, [0.05, 1.0, 0.96], [0, 1, 1])).orderBy("bin").collect()
    assert [r["n"] for r in curve] == [1] + [0] * 8 + [2]
    assert curve[4]["confidence"] is None and curve[9]["accuracy"] == 1.0


def test_block_with_intervals(spark):
    df = forecasts(spark, [0.05, 1.0, 0.96], [0, 1, 1])
    extra = spark.createDataFrame(
        [("m", 9.9, 0.1)], "variant string, brier double, brier_lo double")
    row = C.metrics_block(df, intervals=extra).first()
    assert row["reliability_curve"]["bin_count"] == [1] + [0] * 8 + [2]
    assert row["brier"] < 1 and row["brier_lo"] == 0.1 and row["murphy"]["uncertainty"] == pytest.approx(2 / 9)


def test_statistics_add_up(spark):
    rng = np.random.default_rng(3)
    df = forecasts(spark, rng.integers(0, 101, 400) / 100, rng.integers(0, 2, 400))
    whole = C.score(df).first()
    parts = [C.bin_stats(d) for d in df.randomSplit([0.5, 0.5], 1)]
    merged = C.metrics_from_stats(C.merge_stats(parts[0].union(parts[1]))).first()
    assert merged["n"] == 400
    for name in C.BLOCK:
        assert merged[name] == pytest.approx(whole[name], abs=1e-12)


def reward(spark, text, outcome, **options):
    target = options.pop("target", None)
    df = spark.createDataFrame([(text, outcome, target)], "t string, y int, target double")
    fn = score_reward_fn(**options)
    return df.select(fn(F.col("t"), F.col("y"), F.col("target")).alias("r")).first()["r"]


def test_staged_rewards_find_the_region_once(spark):
    rows = [(f"<think>{i}%</think> so {i * 7 % 120}% it is" if i % 3 else "none", i % 2, i / 100) for i in range(90)]
    df = spark.createDataFrame(rows, "text string, y int, target double")
    for options in ({}, {"sharpness_weight": 0.3, "blend": 0.5, "format_penalty": -1.0}, {"use_soft_target": False}):
        staged = reward_stage(**options)(df, "text", "y", "target")
        plain = df.withColumn("reward", score_reward_fn(**options)(F.col("text"), F.col("y"), F.col("target")))
        assert sorted(map(repr, staged.collect())) == sorted(map(repr, plain.collect()))
        count = [frame._jdf.queryExecution().optimizedPlan().toString().count("think") for frame in (staged, plain)]
        assert count[0] * 4 <= count[1]


@pytest.mark.parametrize("text, outcome, options, expected", [
    ("100%", 1, {}, 1 - 0.01 ** 2), ("0%", 1, {}, 1 - 0.99 ** 2), ("50%", 1, {}, 0.75),
    ("no number", 1, {}, 0.0), ("no number", 1, {"format_penalty": -1.0}, -1.0),
    ("70%", 1, {"target": 0.70}, 1.0), ("70%", 1, {}, 0.91),
    ("60%", 1, {"target": 0.40, "blend": 1.0}, 0.96),
    ("60%", 1, {"target": 0.40, "blend": 0.0}, 0.84),
    ("60%", 1, {"target": 0.40, "blend": 0.5}, 0.99),
    ("70%", 1, {"target": 0.70, "use_soft_target": False}, 0.91),
    ("80%", 1, {"sharpness_weight": 0.3}, 0.96 * 1.09),
])
def test_rewards(spark, text, outcome, options, expected):
    assert reward(spark, text, outcome, **options)["reward"] == pytest.approx(expected)


def test_reward_diagnostics_and_bad_outcomes(spark):
    clipped = reward(spark, "Up 35 in the fourth. 100%", 1)
    assert clipped["format_ok"] and clipped["prob"] == pytest.approx(0.99)
    assert reward(spark, "no idea", 0)["format_ok"] is False
    for outcome in (2, None):
        with pytest.raises(Exception, match="outcome must be 0 or 1"):
            reward(spark, "no idea", outcome)


def test_expected_reward_peaks_at_the_true_rate(spark):
    grid = spark.range(1, 20).select((F.col("id") * 0.05).alias("p"))
    both = [score_reward(F.col("p"), F.lit(y))["reward"] for y in (1, 0)]
    best = grid.select("p", (0.7 * both[0] + 0.3 * both[1]).alias("e")).orderBy(F.desc("e")).first()
    assert best["p"] == pytest.approx(0.7)


def test_group_variance(spark):
    rows = [("a", v) for v in (0.9, 0.9, 0.91, 0.9)] + [("b", v) for v in (0.1, 0.9, 0.5, 0.3)] + [
        ("c", 0.2), ("d", 0.0), ("d", 0.1)]
    df = spark.createDataFrame([(i, g, r) for i, (g, r) in enumerate(rows)],
                               "row_id long, group_id string, reward double")
    kept = telemetry.variance_groups(df).collect()
    assert sorted(r["row_id"] for r in kept) == [4, 5, 6, 7, 9, 10]


def test_coverage_and_validation(spark):
    df = spark.createDataFrame(
        [("m", 0.2, False, 10, 1), ("m", None, True, 20, 0), ("m", 0.4, True, 30, 0)],
        "variant string, prob double, truncated boolean, chars int, outcome int")
    row = C.coverage_report(df).first()
    assert (row["n_total"], row["coverage"]) == (3, pytest.approx(1 / 3))
    assert row["mean_completion_chars"] == 20
    assert cleaning.validate_scores(df, lenient=True) is df
    with pytest.raises(ValueError, match="probabilities"):
        cleaning.validate_scores(df)
    with pytest.raises(ValueError, match="empty"):
        cleaning.validate_scores(df.limit(0))
    with pytest.raises(ValueError, match="probabilities"):
        cleaning.validate_scores(forecasts(spark, [1.2], [1]))
    with pytest.raises(ValueError, match="outcomes"):
        cleaning.validate_scores(forecasts(spark, [0.2], [2]))


def test_leak_guard(spark):
    df = spark.createDataFrame(
        [("clean 7.0", 0.5), ("the Vegas line", 0.5), ("price 0.12 here", 0.125), ("x", None)],
        "prompt string, vegas_wp double")
    found = cleaning.leak_violations(df).collect()
    assert sorted(r["leak"] for r in found) == ["term", "value"]
    assert cleaning.leak_guard(df.where("vegas_wp = 0.5 and prompt like 'clean%'")).count() == 1
    for asked in (lambda g: g.collect(), lambda g: g.count(), lambda g: g.select("vegas_wp").collect()):
        with pytest.raises(Exception, match="leak in prompt"):
            asked(cleaning.leak_guard(df))


def test_training_records_are_guarded_as_they_are_written(spark, tmp_path):
    df = spark.createDataFrame([("train", "price 0.12 here", 0.125)],
                               "split string, prompt string, vegas_wp double")
    with pytest.raises(Exception, match="leak in prompt"):
        write_split_jsonl(df, str(tmp_path / "records"))


def test_scores_refuse_what_is_no_probability(spark):
    for p, y in ((1.2, 1), (-0.1, 0), (0.5, 2)):
        with pytest.raises(Exception, match="probabilities must lie"):
            C.score(forecasts(spark, [0.3, p], [1, y])).collect()
    row = C.score(forecasts(spark, [0.5, float("nan"), None], [1, 1, 1]), ["n", "brier"]).first()
    assert (row["n"], row["brier"]) == (1, 0.25)


def test_unknown_truncation_is_none(spark):
    df = forecasts(spark, [0.5, None, 0.7], [1, 0, 1]).withColumns({
        "truncated": F.lit(None).cast("boolean"), "chars": F.lit(3)})
    assert cleaning.clean_predictions(df).count() == 2
    row = C.coverage_report(df).first()
    assert (row["coverage"], row["truncation"]) == (pytest.approx(2 / 3), 0)


def test_leaderboard_orders(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.1)], "variant string, brier double")
    assert [r["variant"] for r in C.leaderboard(df).collect()] == ["b", "a", "c"]
    assert [r["variant"] for r in C.leaderboard(df, ladder=["c", "b"]).collect()] == ["c", "b", "a"]
    assert C.best_checkpoint(df).first()["variant"] == "c"
    blank = spark.createDataFrame([("b0", None), ("b1", float("nan"))], df.schema)
    assert tuple(C.best_checkpoint(df.unionByName(blank)).first()) == ("c", 0.1)


def test_telemetry_gates_ece(spark):
    rng = np.random.default_rng(5)
    rows = [(s, float(p), int(y), 5) for s, size in ((0, 30), (1, 19))
            for p, y in zip(rng.uniform(0, 1, size), rng.integers(0, 2, size))] + [(0, None, 1, 5)]
    df = spark.createDataFrame(rows, "step int, p double, outcome int, chars int").withColumn(
        "reward", score_reward(F.col("p"), F.col("outcome")))
    got = {r["step"]: r for r in telemetry.reward_telemetry(df).collect()}
    p = np.clip([r[1] for r in rows if r[0] == 0 and r[1] is not None], 0.01, 0.99)
    y = [r[2] for r in rows if r[0] == 0 and r[1] is not None]
    assert got[0]["batch_ece"] == pytest.approx(brute(p, y)["ece"])
    assert got[0]["pred_prob_std"] == pytest.approx(np.std(p))
    assert got[0]["format_success_rate"] == pytest.approx(30 / 31)
    assert got[1]["batch_ece"] is None
