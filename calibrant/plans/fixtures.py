"""Forecasting tables derived from the driver's tables.

The driver has no game data, so every query starts from the same views: ``plays`` has one row per
order, and the rest follows from ``plays``. The view text is portable, so Spark and the checking
engine build identical inputs; the work of an operator is written twice, the inputs once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL_SEASONS = (2000,)
TEST_SEASONS = (2001,)

PLAYS = """
SELECT row_id, group_id, concat('G', CAST(group_id AS STRING)) AS game_id, season,
  CAST(row_id % 18 + 1 AS INT) AS week, 'REG' AS season_type,
  CASE WHEN row_id % 2 = 0 THEN posteam ELSE defteam END AS home_team,
  CASE WHEN row_id % 2 = 0 THEN defteam ELSE posteam END AS away_team,
  posteam, defteam,
  CASE WHEN row_id % 40 = 0 THEN 5 ELSE CAST(4 - floor(seconds / 900e0) AS INT) END AS qtr,
  CASE WHEN row_id % 59 = 0 THEN NULL
    ELSE concat(CAST(CAST(floor((seconds % 900) / 60e0) AS INT) AS STRING), ':',
                lpad(CAST(seconds % 60 AS STRING), 2, '0')) END AS time,
  CAST(seconds AS INT) AS game_seconds_remaining,
  CAST(seconds % 1800 AS INT) AS half_seconds_remaining,
  CASE WHEN group_id % 5 = 0 THEN NULL ELSE CAST(group_id % 5 AS INT) END AS down,
  CAST(row_id % 15 + 1 AS INT) AS ydstogo,
  CASE WHEN row_id % 53 = 0 THEN NULL ELSE CAST(row_id % 101 AS INT) END AS yardline_100,
  CAST(dollars % 57 - 28 AS INT) AS score_differential,
  CAST(dollars % 57 + 28 AS INT) AS posteam_score, CAST(56 AS INT) AS defteam_score,
  CASE WHEN row_id % 97 = 0 THEN NULL ELSE floor(price / 5000e0) / 100e0 END AS vegas_wp,
  CAST(row_id * 37 % 101 AS DOUBLE) / 100e0 AS wp,
  CASE status WHEN 'F' THEN 3 WHEN 'O' THEN -3 ELSE 0 END AS result,
  CAST(40 + row_id % 11 AS DOUBLE) / 2e0 AS total_line,
  CASE WHEN row_id % 41 = 0 THEN NULL
    ELSE CAST(group_id % 31 - 15 AS DOUBLE) / 2e0 END AS spread_line,
  CASE row_id % 3 WHEN 0 THEN concat('Q.', CAST(group_id % 40 AS STRING)) END
    AS passer_player_name,
  CASE row_id % 6 WHEN 0 THEN CAST(row_id % 400 AS DOUBLE) / 2e0 END AS passing_yards,
  CASE row_id % 4 WHEN 0 THEN concat('R.', CAST(group_id % 40 AS STRING)) WHEN 1 THEN '' END
    AS rusher_player_name,
  CASE row_id % 8 WHEN 0 THEN CAST(row_id % 150 AS DOUBLE) END AS rushing_yards,
  CAST(row_id % 13 - 6 AS DOUBLE) / 4e0 AS ep, CAST(row_id % 17 - 8 AS DOUBLE) / 8e0 AS epa,
  CAST(row_id % 19 - 9 AS DOUBLE) / 100e0 AS wpa,
  CASE WHEN season <= 1999 THEN 'train' WHEN season = 2000 THEN 'eval' ELSE 'test' END AS split
FROM (
  SELECT o_orderkey AS row_id, o_custkey AS group_id, CAST(year(o_orderdate) AS INT) AS season,
    concat('T', CAST(o_custkey % 32 AS STRING)) AS posteam,
    concat('T', CAST((o_custkey + 1 + o_orderkey % 31) % 32 AS STRING)) AS defteam,
    CAST(floor(o_totalprice) AS BIGINT) AS dollars,
    CAST(floor(o_totalprice) AS BIGINT) % 3600 AS seconds,
    o_totalprice AS price, o_orderstatus AS status
  FROM {orders}
) o
"""

COMPLETIONS = """
SELECT row_id, group_id, outcome, market,
  CASE CAST(row_id % 8 AS INT)
    WHEN 0 THEN concat('Final: ', whole, '%')
    WHEN 1 THEN concat('<think>around 90% early</think> Win probability: ', whole, ' %')
    WHEN 2 THEN concat('the final probability is 0.', CAST(10 + row_id * 37 % 90 AS STRING))
    WHEN 3 THEN concat('<think>clearly ', whole, '%</THINK> Nothing to add to that.')
    WHEN 4 THEN 'Line 2 is torn off, -13 makes no sense: nothing to offer.'
    WHEN 5 THEN concat('maybe 55-60% here, so answer: ', whole)
    WHEN 6 THEN concat('Drive so far:', chr(10), 'down 3. Probability: unclear. Probability: ',
                       whole, '% now')
    ELSE 'no idea' END AS text,
  CASE WHEN row_id % 9 = 0 THEN concat('I lean ', CAST(row_id * 53 % 101 AS STRING), '%') ELSE '' END
    AS reasoning,
  CASE WHEN row_id % 20 = 0 THEN 'length' ELSE 'stop' END AS finish_reason
FROM (SELECT row_id, group_id, outcome, vegas_wp AS market,
        CAST(row_id * 37 % 101 AS STRING) AS whole FROM {labelled}) c
"""

OUTCOME = """CASE WHEN result = 0 THEN NULL WHEN (result > 0) = (posteam = home_team) THEN 1
  ELSE 0 END"""

LABELLED = f"""
SELECT * FROM (SELECT *, {OUTCOME} AS outcome FROM {{plays}}) x
WHERE outcome IS NOT NULL AND vegas_wp IS NOT NULL
"""

# variant, multiplier, every n-th unparsed, every n-th truncated; unknown for every 43rd
FORECASTERS = [("direct", 37, 11, 20), ("masked", 53, 13, 25), ("zeroshot", 71, 7, 10)]


def _forecast(multiplier: int, unparsed: int, truncated: int) -> dict[str, str]:
    return {
        "prob": f"CASE WHEN row_id % {unparsed} = 0 THEN NULL"
                f" ELSE CAST(row_id * {multiplier} % 101 AS DOUBLE) / 100e0 END",
        "truncated": f"CASE WHEN row_id % 43 = 0 THEN NULL ELSE row_id % {truncated} = 0 END",
        "chars": f"CAST(row_id % {multiplier * 10} + 20 AS INT)",
    }


PREDS = " UNION ALL ".join(
    f"SELECT '{variant}' AS variant, row_id, group_id, game_id, season, outcome,"
    f" vegas_wp AS market, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _forecast(*numbers).items())
    + " FROM {labelled}"
    for variant, *numbers in FORECASTERS)

# label, mode, multiplier
AUDITED = [("base", "cot", 1), ("masked", "masked", 2), ("coupled", "cot", 3)]
_FLAG = "CASE WHEN {} THEN 'true' ELSE 'false' END"
_BODY = "concat('{\"possession_misread\": {\"v\": ', " + _FLAG.format("row_id * k % 7 = 0") + \
    ", ', \"q\": \"has the ball\"}, \"score_inversion\": {\"v\": ', " + \
    _FLAG.format("(row_id + k) % 5 = 0") + \
    ", ', \"q\": \"\"}, \"spread_inversion\": {\"v\": ', " + _FLAG.format("row_id % 11 < k") + \
    ", '}, \"clock_misread\": {\"v\": ', " + _FLAG.format("row_id % 19 = k") + \
    ", ', \"q\": \"\"}, \"pregame_anchor\": {\"v\": ', " + _FLAG.format("row_id % 23 < 2 * k") + \
    ", ', \"q\": \"line\"}, \"faithfulness\": {\"v\": \"', " + \
    "CASE CAST((row_id + 3 * k) % 5 AS INT) WHEN 0 THEN 'inconsistent' WHEN 1 THEN 'unclear'" + \
    " WHEN 2 THEN 'partly' ELSE 'consistent' END, '\", \"q\": \"row ', CAST(row_id AS STRING)," + \
    " '\"}}')"
REPLY = f"""CASE CAST((row_id + k) % 7 AS INT)
  WHEN 0 THEN concat('```json', chr(10), {_BODY}, chr(10), '```')
  WHEN 1 THEN concat('Here is the verdict:', chr(10), {_BODY}, chr(10), 'Done.')
  WHEN 2 THEN 'no verdict today'
  WHEN 3 THEN CASE WHEN row_id % 4 = 0 THEN '{{}}' ELSE {_BODY} END
  WHEN 4 THEN concat({_BODY}, ' trailing }}')
  ELSE {_BODY} END"""
PARSED_PROB = "CASE WHEN row_id % 17 = k THEN NULL ELSE CAST(row_id * (30 + k) % 101 AS DOUBLE)" \
    " / 100e0 END"

AUDITS = " UNION ALL ".join(
    f"SELECT row_id, game_id, label, mode, {PARSED_PROB} AS parsed_prob, {REPLY} AS reply"
    f" FROM (SELECT row_id, game_id, '{label}' AS label, '{mode}' AS mode, {k} AS k"
    " FROM {labelled}) a"
    for label, mode, k in AUDITED)

HAND_LABELS = """
SELECT game_id, CASE WHEN row_id % 2 = 0 THEN 'base' ELSE 'masked' END AS label,
  row_id AS label_no,
  (row_id % 7 = 0) AS possession_misread, (row_id % 5 = 0) AS score_inversion,
  (row_id % 11 < 2) AS spread_inversion, (row_id % 19 = 1) AS clock_misread,
  (row_id % 3 = 0) AS pregame_anchor
FROM {labelled} h WHERE row_id % 3 <> 1
"""

VIEWS = {
    "plays": (PLAYS, ["orders"]),
    "labelled": (LABELLED, ["plays"]),
    "completions": (COMPLETIONS, ["labelled"]),
    "preds": (PREDS, ["labelled"]),
    "audits": (AUDITS, ["labelled"]),
    "hand_labels": (HAND_LABELS, ["labelled"]),
}


def with_views(body: str, *views: str, **extra: str) -> str:
    """Checking SQL: the named views as common table expressions, then ``extra`` ones, then body."""
    chain: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in chain:
            for source in VIEWS[name][1]:
                need(source)
            chain.append(name)

    for view in views:
        need(view)
    parts = []
    for name in chain:
        text, sources = VIEWS[name]
        for source in sources:
            text = text.replace(f"{{{source}}}", source)
        parts.append(f"{name} AS ({text})")
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


class Tables:
    """The driver's tables and the derived views of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def plays(self) -> DataFrame:
        return self.spark.sql(PLAYS, orders=self.read("orders"))

    @cached_property
    def labelled(self) -> DataFrame:
        return self.spark.sql(LABELLED, plays=self.plays)

    @cached_property
    def completions(self) -> DataFrame:
        return self.spark.sql(COMPLETIONS, labelled=self.labelled)

    @cached_property
    def preds(self) -> DataFrame:
        lines = [
            F.struct(F.lit(variant).alias("variant"), *[
                F.expr(sql).alias(name) for name, sql in _forecast(*numbers).items()])
            for variant, *numbers in FORECASTERS]
        return self.labelled.select(
            "row_id", "group_id", "game_id", "season", "outcome", F.col("vegas_wp").alias("market"),
            F.inline(F.array(*lines)))

    @cached_property
    def audits(self) -> DataFrame:
        lines = [F.struct(F.lit(label).alias("label"), F.lit(mode).alias("mode"),
                          F.lit(k).alias("k")) for label, mode, k in AUDITED]
        rows = self.labelled.select("row_id", "game_id", F.inline(F.array(*lines)))
        return rows.select("row_id", "game_id", "label", "mode",
                           F.expr(PARSED_PROB).alias("parsed_prob"), F.expr(REPLY).alias("reply"))

    @cached_property
    def hand_labels(self) -> DataFrame:
        return self.spark.sql(HAND_LABELS, labelled=self.labelled)
