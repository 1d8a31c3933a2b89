import math

import pytest
from pyspark.sql import functions as F

from calibrant.functions import audit, labels, numbers, parsing, wording
from calibrant.operators.records import qa_records, trainer_frame, training_projection
from calibrant.operators.staging import with_verdict
from calibrant.schemas import PLAYS


def column(spark, values, kind, make):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_number_text(spark):
    values = [0.125, 0.375, 0.15, 1234.5, 0.005, 2.675, -0.125]
    assert column(spark, values, "double", lambda x: numbers.fixed_text(x, 2)) == [
        f"{v:.2f}" for v in values]
    assert column(spark, values, "double", lambda x: numbers.round_half_even(x, 2)) == [
        round(v, 2) for v in values]
    shown = [7.0, 0.37, 0.0005, 0.00012, 5e-05, 1.5e-07, 0.0, 1.0, -0.0005]
    assert column(spark, shown, "double", numbers.double_text) == [repr(v) for v in shown]
    halves = [0.5, 1.5, 2.5, -0.5, -2.5, 3.4]
    assert column(spark, halves, "double", numbers.nearest_int) == [round(v) for v in halves]


def test_nan_becomes_null(spark):
    assert column(spark, [math.nan, 1.0, None], "double", numbers.nan_to_null) == [None, 1.0, None]


def test_clipping_keeps_null(spark):
    assert column(spark, [None, -1.0, 0.3, 2.0], "double", numbers.clipped) == [None, 0.0, 0.3, 1.0]


def test_outcome_follows_possession(spark):
    df = spark.createDataFrame([
        (3, "A", "A"), (3, "B", "A"), (-3, "A", "A"), (-3, "B", "A"), (0, "A", "A"), (None, "A", "A"),
    ], "result int, posteam string, home string")
    got = [r[0] for r in df.select(labels.possession_outcome(
        F.col("result"), F.col("posteam"), F.col("home"))).collect()]
    assert got == [1, 0, 0, 1, None, None]


def test_default_season_split(spark):
    got = column(spark, [2015, 2022, 2023, 2024, 2030, None], "int", labels.season_split)
    assert got == ["train", "train", "eval", "test", "train", "train"]


def test_audit_field_position(spark):
    got = column(spark, [50, None, 1, 51, 49, 20, 21, 99], "int", audit.audit_field_position)
    assert got == ["midfield (50)", "unknown", "opponent 1 (red zone)", "own 49", "opponent 49",
                   "opponent 20 (red zone)", "opponent 21", "own 1"]


def test_audit_score_state(spark):
    got = column(spark, [-17.0, -0.0, 1.0, 0.0, 24.0, None], "double",
                 lambda x: audit.audit_score_state(F.lit("OAK"), x))
    assert got == ["OAK trailing by 17", "tied", "OAK leading by 1", "tied", "OAK leading by 24", "tied"]


def test_spread_struct(spark):
    texts = ["odds unknown", "- Pregame line: pick'em\nAsk", "- Pregame line: ELM underdogs by 2.5\nAsk",
             "- Pregame line: OAK favored by 10.5\nAsk"]
    got = column(spark, texts, "string", lambda x: audit.spread_struct(x, F.lit("OAK")))
    assert [tuple(r) for r in got] == [
        ("unknown", "OAK", None), ("pickem", "OAK", 0.0), ("underdog", "ELM", 2.5),
        ("favored", "OAK", 10.5)]


def test_edge_bins_are_half_open(spark):
    leads = [-22, -21, -4, -2, -1, 0, 1, 3, 4, 21, None]
    got = column(spark, leads, "int", lambda x: parsing.edge_bin(x, parsing.SCORE_EDGES))
    assert got == [0, 1, 5, 5, 6, 7, 8, 8, 9, 13, None]


PLAY = dict(
    game_id="m7", season=2019, week=5, season_type="REG", home_team="OAK", away_team="ELM",
    posteam="OAK", defteam="ELM", qtr=2, time="2:41", game_seconds_remaining=1961, down=3,
    ydstogo=6, yardline_100=71, score_differential=0, vegas_wp=0.61, wp=0.6, result=9,
    spread_line=2.5, passer_player_name="P.Tester", passing_yards=88.4)


def plays(spark, *changes):
    rows = [tuple({**PLAY, **change}.get(name) for name in PLAYS.names) for change in changes]
    return spark.createDataFrame(rows, PLAYS)


def test_rendered_question_and_truth(spark):
    qa = qa_records(plays(
        spark, {}, {"qtr": 5, "score_differential": -14, "posteam": "ELM", "defteam": "OAK",
                    "time": None, "down": None, "yardline_100": 50, "passer_player_name": None},
        {"result": 0}, {"vegas_wp": None}))
    rows = qa.withColumn("t", audit.ground_truth()).withColumn(
        "s", audit.stratum(F.col("t"))).collect()
    assert len(rows) == 2
    assert rows[0]["question"] == (
        "NFL game: OAK (possession) vs ELM.\n- 2nd quarter, 2:41 left in the quarter\n"
        "- OAK tied\n- 3rd and 6, ball at their own 29 yard line\n"
        "- Pregame line: OAK favored by 2.5\n"
        "- Personnel on the play: P.Tester at QB (88 pass yds so far)\n\n"
        "Question: What is the probability that OAK win this game? "
        "Reason step by step, then give a final probability as a percentage.")
    truth = rows[0]["t"]
    assert (truth["period"], truth["clock"], truth["score"], truth["field_position"]) == (
        "Q2", "2:41", "tied", "own 29")
    assert tuple(truth["spread"]) == ("favored", "OAK", 2.5)
    assert tuple(rows[0]["s"]) == ("early", "close", "favored")
    assert (rows[0]["actual_outcome"], rows[1]["actual_outcome"]) == (1, 0)
    assert "Overtime, ??:?? left in overtime" in rows[1]["question"]
    assert "between plays, ball at midfield (the 50)" in rows[1]["question"]
    assert rows[1]["t"]["period"] == "overtime"
    assert tuple(rows[1]["s"]) == ("OT", "lopsided", "underdog")


def test_prompt_features_read_back(spark):
    qa = qa_records(plays(spark, {}, {"posteam": "ELM", "defteam": "OAK", "yardline_100": 12,
                                      "down": 4}, {"spread_line": 0.0, "yardline_100": None}))
    rows = qa.select(parsing.posteam_spread(F.col("question")),
                     parsing.parse_yardline(F.col("question")),
                     parsing.parse_down(F.col("question"))).collect()
    assert [tuple(r) for r in rows] == [(2.5, 71, 3), (-2.5, 12, 4), (0.0, 50, 3)]


def test_trainer_rows_carry_no_market_price(spark):
    slim = training_projection(qa_records(plays(spark, {})))
    assert slim.columns == ["prompt", "actual_outcome", "vegas_wp", "game_id", "season",
                            "difficulty", "meta"]
    rows = trainer_frame(slim, "masked")
    assert rows.columns == ["prompt", "actual_outcome", "target"]
    message = rows.first()["prompt"][0]
    assert message["role"] == "user"
    assert message["content"].endswith("Probability: NN%   (NN = the win probability).")


def test_modes(spark):
    got = column(spark, [f"Q {wording.INSTRUCTIONS['cot']}"], "string",
                 lambda x: wording.prompt_mode(x, "direct"))
    assert got == [f"Q {wording.INSTRUCTIONS['direct']}"]


FLAGS = '{"possession_misread": {"v": %s, "q": "x"}, "faithfulness": {"v": "unclear", "q": "y"}}'


@pytest.mark.parametrize("reply, ok, usable, strict, loose", [
    (FLAGS % "true", True, True, True, True),
    ("```json\n" + FLAGS % "false" + "\n```", True, True, False, False),
    ("```\n" + FLAGS % "true" + "\n``` and {more}", True, True, True, True),
    ("Here:\n" + FLAGS % "true" + "\nDone.", True, True, True, True),
    (FLAGS % '"false"', True, True, None, True),
    (FLAGS % '""', True, True, None, False),
    (FLAGS % "1", True, True, None, True),
    (FLAGS % "0", True, True, None, False),
    (FLAGS % "null", True, True, None, False),
    (FLAGS % "[]", True, True, None, False),
    ("{}", True, False, None, False),
    (FLAGS % "true" + " x }", False, False, None, False),
    (FLAGS % "true" + "] x }", False, False, None, False),
    (FLAGS % "true" + "} x }", False, False, None, False),
    (FLAGS % "true" + ", {}", False, False, None, False),
    ("{'a': 1}", False, False, None, False),
    ("no json at all", False, False, None, False),
])
def test_verdicts(spark, reply, ok, usable, strict, loose):
    df = spark.createDataFrame([(reply,)], "reply string")
    for mode, expected in ((True, strict), (False, loose)):
        direct = df.select(audit.parse_verdict(F.col("reply"), mode).alias("verdict")).first()[0]
        staged = with_verdict(df, strict=mode).first()["verdict"]
        assert direct == staged
        assert (direct["parse_ok"], direct["usable"]) == (ok, usable)
        assert direct["possession_misread"]["v"] == expected


def test_request_is_blind_and_complete(spark):
    qa = qa_records(plays(spark, {})).withColumn("t", audit.ground_truth())
    text = qa.select(audit.judge_request(
        F.col("t"), F.lit("  I say 5%.\n"), F.lit(0.05))).first()[0]
    assert "- Pregame line: OAK favored by 2.5\n" in text
    assert '"""\nI say 5%.\n"""' in text
    assert "final stated probability that OAK wins: 0.05\n" in text
    missing = qa.select(audit.judge_request(
        F.col("t"), F.lit("x"), F.lit(None).cast("double"), True)).first()[0]
    assert "wins: None\n" in missing
    assert missing.endswith("Return ONLY the JSON object.")


def test_request_messages(spark):
    qa = qa_records(plays(spark, {})).withColumn("t", audit.ground_truth())
    messages = qa.select(audit.judge_messages(F.col("t"), F.lit("why"), F.lit(0.5)).alias("m"),
                         audit.judge_request(F.col("t"), F.lit("why"), F.lit(0.5)).alias("r")).first()
    assert [(m["role"], m["content"]) for m in messages["m"]] == [
        ("system", audit.SYSTEM_MESSAGE), ("user", messages["r"])]
