from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from calibrant.functions import audit
from calibrant.functions.extract import answer_region
from calibrant.operators import judging, pairing, requests, trajectory
from calibrant.operators.joins import salted_join
from calibrant.operators.staging import with_verdict
from calibrant.plans import catalog_audits


def kappa(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    return judging.agreement(judging.count_pairs(df, "a", "b")).first()


def test_kappa(spark):
    assert kappa(spark, [1, 0, 1, 0], [1, 0, 1, 0])["kappa"] == pytest.approx(1)
    assert kappa(spark, [1, 1, 0, 0], [1, 0, 1, 0])["kappa"] == pytest.approx(0)
    same = kappa(spark, [1, 1], [1, 1])
    assert (same["kappa"], same["agree"], same["n"]) == (1.0, 1.0, 2)
    three = kappa(spark, [0, 1, 2, 2], [0, 1, 1, 3])
    expected = (1 * 1 + 1 * 2) / 16
    assert three["kappa"] == pytest.approx((0.5 - expected) / (1 - expected))


def reply(flag, faith="consistent", why="w"):
    return ('{"possession_misread": {"v": %s, "q": ""}, "faithfulness": {"v": "%s", "q": "%s"}}'
            % (str(flag).lower(), faith, why))


def judged(spark, rows):
    df = spark.createDataFrame(
        rows, "row_id long, game_id string, label string, parsed_prob double, reply string")
    return with_verdict(df)


def hand(spark, rows):
    flags = ", ".join(f"{c} boolean" for c in (
        "possession_misread", "score_inversion", "spread_inversion", "clock_misread",
        "pregame_anchor"))
    return spark.createDataFrame(
        [(g, m, i, *f) for i, (g, m, *f) in enumerate(rows)],
        f"game_id string, label string, label_no int, {flags}")


def test_rates_and_denominators(spark):
    rows = [(0, "g", "m", 0.5, reply(True, "inconsistent")), (1, "g", "m", 0.5, reply(False, "partly")),
            (2, "g", "m", 0.5, "none"), (3, "g", "m", 0.5, "{}")]
    frame = judged(spark, rows)
    assert tuple(judging.judge_failures(frame).first()) == ("m", 4, 1)
    rates = {r["category"]: r for r in judging.verdict_rates(frame, reps=50).collect()}
    assert (rates["possession_misread"]["n"], rates["possession_misread"]["rate"]) == (2, 0.5)
    assert rates["faithfulness(inconsistent)"]["rate"] == 0.5
    legal = judging.faithfulness_rates(frame, reps=50).first()
    assert (legal["n"], legal["rate"]) == (1, 1.0)


def test_last_hand_label_counts_and_hot_keys_pair(spark):
    rows = [(i, "hot", "m", 0.5, reply(i % 2 == 0)) for i in range(40)] + [
        (90, "cold", "m", 0.5, reply(True)), (91, "other", "m", 0.5, reply(True))]
    labels = hand(spark, [
        ("hot", "m", False, False, False, False, False),
        ("hot", "m", True, False, False, False, False),
        ("cold", "m", None, False, False, False, False)])
    joined = judging.human_label_join(judged(spark, rows), labels).collect()
    assert len(joined) == 41
    assert all(r["human_possession_misread"] for r in joined if r["game_id"] == "hot")
    pairs = judging.rater_pairs(judged(spark, rows), labels)
    agree = {r["category"]: r for r in judging.agreement(pairs, ["category"]).collect()}
    assert agree["possession_misread"]["n"] == 41
    assert agree["possession_misread"]["agree"] == pytest.approx(20 / 41)
    assert agree["clock_misread"]["kappa"] == 1.0


def test_flips(spark):
    frame = judged(spark, [
        (0, "g", "a", 0.1, reply(False, "inconsistent", "a0")),
        (0, "g", "b", 0.2, reply(False, "consistent", "b0")),
        (1, "g", "a", 0.1, reply(False, "consistent")),
        (1, "g", "b", 0.2, reply(False, "consistent")),
        (2, "g", "a", None, reply(False, "inconsistent", "a2")),
        (2, "g", "b", 0.4, reply(False, "consistent", "b2")),
    ]).withColumn("ground_truth", F.expr("""named_struct('game_id', 'g', 'period', 'Q2',
        'clock', cast(null as string), 'posteam', 'OAK', 'score', 'tied', 'down', 3, 'ydstogo', 9,
        'field_position', 'own 7', 'spread', named_struct('team', 'ELM', 'points', 2.5D),
        'target_prob', 0.375D, 'actual_outcome', 0)"""))
    got = judging.flip_examples(frame, "a", "b").orderBy("row_id").collect()
    assert [(r["row_id"], r["a_why"], r["b_why"], r["a_prob"]) for r in got] == [
        (0, "a0", "b0", 0.1), (2, "a2", "b2", None)]
    report = judging.flip_report(judging.flip_examples(frame, "a", "b"), 1).collect()
    assert [tuple(r) for r in report] == [(
        0, 2, "g | Q2 None | OAK tied | down 3&9 | own 7 | spread ELM 2.5 | phat=0.38 outcome=0",
        "p=0.1: a0", "p=0.2: b0")]


def test_views(spark):
    df = spark.createDataFrame([(0, "m", 0.5, "x" * 300 + "\nend", 1, 0.5, 0.5)],
                               "row_id long, variant string, prob double, text string, outcome int,"
                               " target double, market double")
    row = judging.side_by_side(df, answer_region(F.col("text")), ["m", "other"]).first()
    assert len(row["m"]["answer_tail"]) == 220 and row["m"]["answer_tail"].endswith("x end")
    assert row["m"]["prob"] == 0.5 and row["other"] is None
    ends = judging.tail_head_views(df, F.col("text"), 4).first()
    assert (ends["head"], ends["tail"], ends["chars"]) == ("xxxx", "\nend", 304)


def test_fan_out(spark):
    rows = judging.fan_out_variants(spark.range(3), [("base", "cot"), ("x", "masked")])
    assert rows.count() == 6 and set(rows.columns) == {"id", "label", "mode"}


def long_preds(spark):
    rows = [("a", 0, 0.1, 1), ("a", 1, None, 0), ("a", 2, 0.7, 1), ("b", 0, 0.2, 1), ("b", 1, 0.3, 0),
            ("b", 2, 1.4, 0)]
    return spark.createDataFrame(
        [(v, i, p, y, 0.5, False) for v, i, p, y in rows],
        "variant string, row_id long, prob double, outcome int, market double, truncated boolean")


def test_pairing(spark):
    preds = long_preds(spark).withColumn("outcome", F.when(F.col("row_id") == 1, 0).otherwise(1))
    assert [tuple(r) for r in pairing.paired_join(preds, "a", "b").orderBy("row_id").collect()] == [
        (0, 0.1, 0.2, 0.5, 1), (2, 0.7, 1.4, 0.5, 1)]
    assert pairing.paired_join(preds, "a", "b", both_parsed=False).count() == 3


def test_misaligned_items_are_refused(spark):
    good = long_preds(spark)
    extra = good.where("variant = 'a' and row_id = 0")
    spoiled = {
        "not in the second": good.where("not (variant = 'b' and row_id = 1)"),
        "not in the first": good.where("not (variant = 'a' and row_id = 1)"),
        "repeated": good.unionByName(extra.withColumn("prob", F.lit(0.9))),
        "markets differ": good.withColumn("market", F.when(
            (F.col("variant") == "a") | (F.col("row_id") != 1), F.col("market")).otherwise(0.1)),
    }
    kept = good.where("row_id < 2")
    assert pairing.pairing_violations(kept, "a", "b").count() == 0
    assert pairing.pairing_violations(good, "a", "b").collect()[0]["fault"] == "outcomes differ"
    for fault, preds in spoiled.items():
        preds = preds.where("row_id < 2")
        found = pairing.pairing_violations(preds, "a", "b").collect()
        assert [r["fault"] for r in found] == [fault]
        # Also when the columns that show it are not asked for.
        for asked in (lambda df: df.count(), lambda df: df.select("row_id").collect()):
            with pytest.raises(Exception, match=fault):
                asked(pairing.paired_join(preds, "a", "b", both_parsed=False))
    assert pairing.aligned_models(kept, ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="misaligned"):
        pairing.aligned_models(good, ["a", "b"]).count()


def test_features_of_every_row(spark):
    scored = spark.createDataFrame([(1, 0.5, 1), (2, 0.5, 0)], "row_id long, prob double, y int")
    features = spark.createDataFrame([(1, 1, 7), (2, 0, 8), (3, 0, 9)], "row_id long, y int, down int")
    got = pairing.features_join(scored, features, outcome="y").orderBy("row_id").collect()
    assert [(r["down"], r["outcome_agrees"]) for r in got] == [(7, True), (8, True)]
    for bad in (features.where("row_id != 2"), features.withColumn("y", 1 - F.col("y"))):
        with pytest.raises(Exception, match="no features"):
            pairing.features_join(scored, bad, outcome="y").count()
        assert pairing.features_join(scored, bad, outcome="y", strict=False).count() == 2
    with pytest.raises(Exception, match="twice"):
        pairing.features_join(scored, features.unionByName(features), outcome="y").count()


def test_alignment(spark):
    wide = pairing.align_models(long_preds(spark), ["a", "b"]).orderBy("row_id").collect()
    assert [r["aligned"] for r in wide] == [True, True, False]
    assert wide[1]["a"] is None and wide[2]["b"] == 1.0
    assert pairing.alignment_violations(long_preds(spark), ["a", "b"]).count() == 1


def test_requests(spark):
    asked = spark.createDataFrame([("m", "p1"), ("m", "p1"), ("m", "p2"), ("n", "p1")],
                                  "model string, prompt string")
    keyed = requests.with_request_key(
        asked, F.col("model"), F.col("prompt"), temperature=F.lit(0.7), system=F.lit(""))
    assert keyed.select("key").distinct().count() == 3
    store = keyed.where("prompt = 'p2'").select(
        "key", F.lit(1).alias("at"), F.lit("old").alias("text"))
    fresh = keyed.where("prompt = 'p2' or model = 'n'").select(
        "key", F.lit(2).alias("at"), F.lit("new").alias("text"))
    merged = requests.merge_store(store, fresh, "at")
    assert sorted(r["text"] for r in merged.collect()) == ["new", "old"]
    assert requests.pending_requests(keyed, merged).count() == 1
    answered = requests.answered_requests(keyed, merged, answer=["text"])
    assert answered.count() == 4 and answered.where("text is null").count() == 2


def test_anchor_only_where_step_zero_is_absent(spark):
    points = spark.createDataFrame(
        [("r1", 50, "brier", 0.3), ("r2", 0, "brier", 0.2), ("r3", 50, "brier", 0.1),
         ("r1", 50, "mce", 0.9)], "run string, step int, metric string, value double")
    rows = trajectory.trajectory_series(points, {"brier": 0.25}, ["r1", "r2"]).collect()
    assert [tuple(r) for r in rows] == [
        ("r1", 0, "brier", 0.25), ("r1", 50, "brier", 0.3), ("r1", 50, "mce", 0.9),
        ("r2", 0, "brier", 0.2), ("r3", 50, "brier", 0.1)]
    assert trajectory.trajectory_series(points).count() == 4


@pytest.mark.parametrize("how, expected", [("inner", 50), ("left", 60), ("left_semi", 50)])
def test_salted_join_changes_no_rows(spark, how, expected):
    rows = spark.range(60).select("id", F.when(F.col("id") < 50, 1).otherwise(2).alias("k"))
    lookup = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    assert salted_join(rows, lookup, ["k"], how, "id").count() == expected


def test_messages_of_every_request(spark, sf_dir):
    queries = contract.queries()
    rows = queries["judge_messages_text"](spark, sf_dir).collect()
    requests_ = {r.row_id: r.request for r in queries["judge_request"](spark, sf_dir).collect()}
    assert {r.row_id: r.content for r in rows if r.role == "user"} == requests_
    assert {r.row_id for r in rows if r.content == audit.SYSTEM_MESSAGE} == set(requests_)
    assert len(rows) == 2 * len(requests_) and any(i % 9 for i in requests_)


def test_judged_lines_never_broadcast_ground_truths(spark, tmp_path, monkeypatch):
    """Ground truths are far wider than the orders file that Spark estimates them by."""
    spark.createDataFrame(
        [(k, k % 7, "FOP"[k % 3], 1000.0 * k, datetime(1998, 1, 1)) for k in range(60)],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    plans, write = [], catalog_audits.judged_source.write_judged

    def seen(rows, path):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, path)

    monkeypatch.setattr(catalog_audits.judged_source, "write_judged", seen)
    rows = contract.queries()["judged_source_sink"](spark, str(tmp_path)).collect()
    assert "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    assert sorted((r.row_id, r.label) for r in rows) == sorted(
        (k, label) for k in range(60) if k % 3 != 2 and k % 97 for label in ("base", "coupled", "masked"))
