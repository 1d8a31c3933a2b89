"""Row schemas of the files the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
          "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct_of(columns: str, **nested: T.DataType) -> T.StructType:
    """``"a int, b string"`` as a struct, without a session; ``nested`` gives other named types."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(n, nested[t] if t in nested else _TYPES[t]) for n, t in pairs])


# The column names and types of a raw play-by-play table.
PLAYS = struct_of("""
    game_id string, season int, week int, season_type string,
    home_team string, away_team string, posteam string, defteam string,
    qtr int, time string, game_seconds_remaining int, half_seconds_remaining int,
    down int, ydstogo int, yardline_100 int, score_differential int,
    posteam_score int, defteam_score int,
    vegas_wp double, wp double, result int, total_line double, spread_line double,
    passer_player_name string, passing_yards double,
    rusher_player_name string, rushing_yards double,
    ep double, epa double, wpa double
""")
PLAY_COLUMNS = PLAYS.fieldNames()

# A play can be asked about only when all of these are known.
PLAY_REQUIRED = [
    "posteam", "defteam", "vegas_wp", "result", "down", "game_seconds_remaining",
]

FEATURES = struct_of("""
    posteam string, defteam string, qtr int, time string, game_seconds_remaining int,
    down int, ydstogo int, yardline_100 int, score_differential int,
    vegas_wp double, wp double, epa double, spread_line double
""")

QA_RECORD = struct_of("""
    question string, target_prob double, actual_outcome int, game_id string, season int,
    week int, difficulty double, features features
""", features=FEATURES)

TRAINING_RECORD = struct_of("""
    prompt string, actual_outcome int, vegas_wp double, game_id string, season int,
    difficulty double, meta meta, target double, target_fine double
""", meta=struct_of("qtr int, score_differential int, game_seconds_remaining int, week int"))

# One prediction inside a prediction map. ``row_id`` is ours: it makes the position durable.
PREDICTION = struct_of("""
    row_id bigint, game_id string, prob double, outcome int, vegas double,
    parsed boolean, truncated boolean
""")
PREDICTION_MAP = T.MapType(T.StringType(), T.ArrayType(PREDICTION))

GROUND_TRUTH = struct_of("""
    game_id string, season int, week int, posteam string, defteam string, period string,
    clock string, score string, score_differential int, down int, ydstogo int,
    field_position string, spread spread,
    vegas_wp double, target_prob double, actual_outcome int
""", spread=struct_of("side string, team string, points double"))

# The categories of one audit verdict.
BOOLEAN_CATEGORIES = [
    "possession_misread", "score_inversion", "spread_inversion", "clock_misread", "pregame_anchor",
]
FAITHFULNESS_LABELS = ["consistent", "inconsistent", "unclear"]

VERDICT = T.StructType(
    [T.StructField(c, struct_of("v boolean, q string")) for c in BOOLEAN_CATEGORIES]
    + [T.StructField("faithfulness", struct_of("v string, q string"))]
)

JUDGED_ROW = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("ground_truth", GROUND_TRUTH),
    T.StructField("models", T.MapType(T.StringType(), T.StructType([
        T.StructField("mode", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("parsed_prob", T.DoubleType()),
        T.StructField("verdict", VERDICT),
    ]))),
])
