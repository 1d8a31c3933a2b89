import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from calibrant.operators.cleaning import clean_plays
from calibrant.schemas import PLAYS, VERDICT
from calibrant.session import freeze, run_folder, shared_folder
from calibrant.sources import judged, logs, metrics, plays, predictions, records


def test_season_specs():
    assert plays.parse_seasons("2015-2017,2020") == [2015, 2016, 2017, 2020]
    assert plays.parse_seasons("2023") == [2023]
    assert plays.parse_seasons("2021,2019") == [2019, 2021]


def test_plays_round_trip(spark):
    rows = [dict(season=2022, posteam="A", defteam="B", vegas_wp=0.5, result=1, down=1,
                 game_seconds_remaining=5, wp=math.nan),
            dict(season=2023, posteam="A", defteam="B", vegas_wp=math.nan, result=1, down=1,
                 game_seconds_remaining=5, wp=0.1)]
    raw = spark.createDataFrame([tuple(r.get(n) for n in PLAYS.names) for r in rows], PLAYS)
    path = run_folder(spark, "plays")
    plays.write_plays(raw, path)
    assert plays.scan_plays(spark, path).where("wp is null").count() == 1
    assert clean_plays(plays.scan_plays(spark, path)).count() == 1
    pruned = plays.scan_plays(spark, path, "2023", ["season", "posteam"])
    assert pruned.count() == 1
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "vegas_wp" not in plan


def test_absent_columns(spark):
    df = spark.range(1)
    with pytest.warns(UserWarning, match="missing_one"):
        assert plays.select_required(df, ["id", "missing_one"]).columns == ["id"]
    with pytest.raises(ValueError, match="missing_one"):
        plays.select_required(df, ["id", "missing_one"], strict=True)


def test_bad_record_is_an_error(spark):
    path = run_folder(spark, "bad")
    spark.createDataFrame([('{"a": 1}',), ('{"a": ',)], "value string").write.text(path)
    with pytest.raises(Exception):
        records.read_jsonl(spark, path, "a int").collect()


def entry(prob, outcome=1, **more):
    return dict(game_id="g", prob=prob, outcome=outcome, vegas=0.5, parsed=prob is not None,
                truncated=False, **more)


def test_foreign_prediction_maps_are_read_by_position(spark):
    whole = {"zeroshot": [entry(0.1), entry(None), entry(0.3)], "ckpt": [entry(0.2)]}
    lines = spark.createDataFrame([(json.dumps(whole, indent=1),)], "value string")
    rows = predictions.parse_prediction_maps(lines).orderBy("variant", "row_id").collect()
    assert [(r["variant"], r["row_id"], r["prob"], r["market"]) for r in rows] == [
        ("ckpt", 0, 0.2, 0.5), ("zeroshot", 0, 0.1, 0.5), ("zeroshot", 1, None, 0.5),
        ("zeroshot", 2, 0.3, 0.5)]
    bare = spark.createDataFrame([(json.dumps([entry(0.4)]),)], "value string")
    assert predictions.parse_prediction_maps(bare).first()["variant"] == "_"


def test_prediction_lines_are_bounded(spark):
    preds = spark.range(100).select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("variant"), F.col("id").alias("row_id"),
        F.lit("g").alias("game_id"), (F.col("id") / 100).alias("prob"), F.lit(1).alias("outcome"),
        F.lit(0.5).alias("market"), F.lit(False).alias("truncated"))
    lines = predictions.prediction_map_lines(preds, 30)
    parsed = [json.loads(r["value"]) for r in lines.collect()]
    assert len(parsed) == 4 and max(len(v) for m in parsed for v in m.values()) == 30
    path = run_folder(spark, "maps")
    predictions.write_prediction_maps(preds, path, 30)
    back = predictions.read_prediction_maps(spark, path, "b").orderBy("row_id").collect()
    assert [r["prob"] for r in back] == [i / 100 for i in range(100)]
    with pytest.raises(ValueError, match="'x'"):
        predictions.read_prediction_maps(spark, path, "x")


def test_positions_are_row_ids_of_one_object(spark):
    def read(*lines):
        df = spark.createDataFrame([(line,) for line in lines], "value string")
        return sorted((r["variant"], r["row_id"]) for r in
                      predictions.parse_prediction_maps(df).select("variant", "row_id").collect())

    bare, held = '[{"prob": 0.1}, {"prob": 0.2}]', '[{"row_id": 7, "prob": 0.1}]'
    assert read(bare) == [("_", 0), ("_", 1)]
    assert read(held, held.replace("7", "9")) == [("_", 7), ("_", 9)]
    assert read(bare, f'{{"x": {bare}}}') == [("_", 0), ("_", 1), ("x", 0), ("x", 1)]
    with pytest.raises(Exception, match="without row ids"):
        read(bare, bare)


def test_log_lines(spark, tmp_path):
    for run, lines in {
        "one": ["noise", "[eval @ 50]  {'eval/brier': 0.3, 'eval/ece': None}",
                "x [eval @ 0] {'eval/brier': 0.5}", "[eval @ 50] {'eval/brier': 0.25}",
                "[eval @ 100] {'eval/brier': oops}", "[eval @ 7] generating 3 prompts",
                "[eval @ 150] {'eval/brier': 0.2, 'eval/note': 'warm', }"],
        "two": ["[eval @ 50] {'eval/brier': 0.1, 'eval/resolution': 0.04}"],
    }.items():
        (tmp_path / f"{run}.log").write_text("\n".join(lines))
    rows = logs.log_scan(spark, str(tmp_path)).orderBy("run", "step", "metric").collect()
    assert [tuple(r) for r in rows] == [
        ("one.log", 0, "brier", 0.5), ("one.log", 50, "brier", 0.25),
        ("one.log", 150, "brier", 0.2), ("one.log", 150, "note", None),
        ("two.log", 50, "brier", 0.1), ("two.log", 50, "resolution", 0.04)]


def test_judged_rows_of_other_tools(spark, tmp_path):
    row = {"ground_truth": {"game_id": "g", "period": "Q1"}, "models": {
        "base": {"mode": "cot", "text": "t", "parsed_prob": 0.2, "verdict": {
            "clock_misread": {"v": True, "q": "x"}, "faithfulness": {"v": "unclear", "q": ""}}},
        "tuned": {"mode": "cot", "text": "t", "parsed_prob": None, "verdict": None}}}
    (tmp_path / "judged.jsonl").write_text(json.dumps(row) + "\n")
    rows = {r["label"]: r for r in judged.read_judged(spark, str(tmp_path)).collect()}
    assert rows["base"]["verdict"]["usable"] and rows["base"]["verdict"]["clock_misread"]["v"]
    assert not rows["tuned"]["verdict"]["parse_ok"]


def test_judged_rows_that_repeat_a_label(spark):
    """Every row comes back, with its own ground truth: repeats, a second truth, and a lone row."""
    state, verdict = "struct<game_id: string>", "struct<" + ", ".join(
        ["parse_ok: boolean", *[f"{f.name}: {f.dataType.simpleString()}" for f in VERDICT.fields]]) + ">"
    found = (True, *[(True, "q")] * 5, ("unclear", "why"))
    rows = [(1, ("g",), "base", "cot", "a", 0.1, found), (1, ("g",), "base", "cot", "b", None, found),
            (1, ("g",), "base", "cot", "a", 0.1, found), (1, ("g",), "tuned", "cot", "c", 0.2, found),
            (1, ("h",), "tuned", "cot", "d", 0.2, found), (2, ("g",), "base", "cot", "e", 0.3, None)]
    frame = spark.createDataFrame(
        rows, f"row_id bigint, ground_truth {state}, label string, mode string, text string,"
        f" parsed_prob double, verdict {verdict}")
    path = run_folder(spark, "judged")
    judged.write_judged(frame, path)
    back = judged.read_judged(spark, path).collect()
    assert sorted((r.row_id, r.ground_truth.game_id, r.label, r.text, r.parsed_prob is None, r.verdict.usable)
                  for r in back) == sorted(
        (row_id, game, label, text, prob is None, v is not None) for row_id, (game,), label, _, text, prob, v in rows)
    assert spark.read.text(path).count() == 5


def test_metric_files(spark):
    results = spark.createDataFrame([("m", None), ("n", 0.5)], "variant string, brier double")
    for form in ("json", "parquet"):
        path = run_folder(spark, "metrics")
        metrics.write_metrics(results, path, form)
        back = spark.read.schema(results.schema).format(form).load(path)
        assert sorted(map(tuple, back.collect())) == [("m", None), ("n", 0.5)]
    with pytest.raises(ValueError):
        metrics.write_metrics(results, uuid.uuid4().hex, "csv")


def test_frozen_frames_are_written_to_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None)
                      or spark.sparkContext.getCheckpointDir())
    frozen = freeze(spark.range(5))
    assert frozen.count() == 5
    assert "ExistingRDD" in frozen._jdf.queryExecution().executedPlan().toString()
