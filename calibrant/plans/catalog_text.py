"""Prompt clauses, their parsers, probability extraction and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.functions import audit, extract, parsing, wording
from calibrant.functions.scoring import score_reward
from calibrant.operators.staging import computed_once, reward_stage, with_probability
from calibrant.operators.telemetry import variance_groups
from calibrant.plans import sqltext as S
from calibrant.plans.fixtures import Tables, with_views
from calibrant.plans.registry import query, rounded
from calibrant.operators.records import qa_records


def _clause(t: Tables, column, name: str) -> DataFrame:
    return t.plays.select("row_id", column.alias(name))


@query("ordinal", with_views(
    f"SELECT row_id, {S.ORDINAL.format(n='week')} AS ordinal FROM plays", "plays"))
def ordinal(t: Tables):
    return _clause(t, wording.ordinal(F.col("week")), "ordinal")


@query("field_position_text", with_views(
    f"SELECT row_id, {S.FIELD_TEXT} AS field FROM plays", "plays"))
def field_position_text(t: Tables):
    return _clause(t, wording.field_position_text(F.col("yardline_100"), F.col("defteam")), "field")


@query("score_clause", with_views(f"SELECT row_id, {S.SCORE_TEXT} AS score FROM plays", "plays"))
def score_clause(t: Tables):
    return _clause(t, wording.score_clause(F.col("score_differential")), "score")


@query("spread_clause", with_views(f"SELECT row_id, {S.SPREAD_TEXT} AS line FROM plays", "plays"))
def spread_clause(t: Tables):
    return _clause(t, wording.spread_clause(
        F.col("spread_line"), F.col("posteam"), F.col("home_team")), "line")


@query("player_clause", with_views(f"SELECT row_id, {S.PLAYER_TEXT} AS people FROM plays", "plays"))
def player_clause(t: Tables):
    return _clause(t, wording.player_clause(
        F.col("passer_player_name"), F.col("passing_yards"), F.col("rusher_player_name"),
        F.col("rushing_yards")), "people")


@query("clock_clause", with_views(f"SELECT row_id, {S.CLOCK_TEXT} AS clock FROM plays", "plays"))
def clock_clause(t: Tables):
    return _clause(t, wording.clock_clause(F.col("qtr"), F.col("time")), "clock")


@query("render_prompt", with_views(f"SELECT row_id, {S.PROMPT} AS prompt FROM plays", "plays"))
def render_prompt(t: Tables):
    return _clause(t, wording.render_prompt(), "prompt")


@query("posteam_spread", with_views(
    f"SELECT row_id, coalesce({S.POSSESSION_LINE}, 0) + 0 AS spread FROM plays", "plays"))
def posteam_spread(t: Tables):
    return _clause(t, parsing.posteam_spread(wording.render_prompt()), "spread")


@query("parse_yardline", with_views(
    "SELECT row_id, coalesce(yardline_100, 50) AS yards FROM plays", "plays"))
def parse_yardline(t: Tables):
    return _clause(t, parsing.parse_yardline(wording.render_prompt()), "yards")


@query("parse_down", with_views("SELECT row_id, coalesce(down, 0) AS down FROM plays", "plays"))
def parse_down(t: Tables):
    return _clause(t, parsing.parse_down(wording.render_prompt()), "down")


@query("answer_region", with_views(
    f"SELECT row_id, {S.region('text')} AS region FROM completions", "completions"))
def answer_region(t: Tables):
    return t.completions.select("row_id", extract.answer_region(F.col("text")).alias("region"))


@query("coerce_prob", with_views(
    """SELECT row_id, CASE WHEN pct BETWEEN 0 AND 1 THEN pct END AS from_percent,
       CASE WHEN bare BETWEEN 0 AND 1 THEN bare END AS from_bare FROM (
         SELECT row_id, (row_id % 140 - 20) / 100 AS pct,
         CASE WHEN row_id % 140 - 20 > 1 THEN (row_id % 140 - 20) / 100 ELSE row_id % 140 - 20 END
         AS bare FROM completions) c""", "completions"))
def coerce_prob(t: Tables):
    raw = (F.col("row_id") % 140 - 20).cast("string")
    return t.completions.select(
        "row_id", extract.coerce_prob(raw, True).alias("from_percent"),
        extract.coerce_prob(raw, False).alias("from_bare"))


@query("extract_probability", with_views(
    S.extracted("completions", "text", "row_id"), "completions"))
def extract_probability(t: Tables):
    return t.completions.select("row_id", extract.extract_probability(F.col("text")).alias("prob"))


@query("extract_probability_documents", S.extracted("documents", "text", "doc_id"))
def extract_probability_documents(t: Tables):
    return t.read("documents").select(
        "doc_id", extract.extract_probability(F.col("text")).alias("prob"))


@query("extract_probability_pages", S.extracted("pages", "html", "page_id"))
def extract_probability_pages(t: Tables):
    return t.read("pages").select(
        "page_id", extract.extract_probability(F.col("html")).alias("prob"))


_FULL = "concat('<think>', reasoning, '</think>', chr(10), text)"
RESPONSES = f"""SELECT a.row_id, a.outcome, a.market, a.group_id, a.text, a.reasoning,
    coalesce(a.prob, b.prob) AS prob, a.finish_reason = 'length' AS truncated
    FROM (SELECT * FROM ({S.extracted('completions', 'text', '*')}) x) a
    JOIN (SELECT * FROM ({S.extracted(
        f"(SELECT row_id, CASE WHEN reasoning <> '' THEN {_FULL} ELSE '' END AS full_text"
        " FROM completions)", 'full_text', 'row_id')}) y) b ON a.row_id = b.row_id"""


def responses(t: Tables) -> DataFrame:
    parsed = with_probability(t.completions, reasoning="reasoning")
    return parsed.withColumn("truncated", extract.is_truncated(F.col("finish_reason")))


@query("response_probability", with_views(
    "SELECT row_id, prob, truncated FROM responses", "completions", responses=RESPONSES))
def response_probability(t: Tables):
    return responses(t).select("row_id", "prob", "truncated")


@query("completion_text", """SELECT conv_id, arg_max(text, turn) AS completion, max(turn) AS turn
  FROM conversations GROUP BY conv_id""")
def completion_text(t: Tables):
    """Conversations gathered into chat messages, in order of their turns, and read by the operator."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    chats = t.read("conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(message)).alias("messages"), F.max("turn").alias("turn"))
    return chats.select("conv_id", extract.completion_text(F.col("messages")).alias("completion"), "turn")


@query("completion_text_chat", """SELECT conv_id, turn, text AS completion FROM conversations""")
def completion_text_chat(t: Tables):
    """A turn as chat messages and back to its text."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit("").alias("content")),
        F.struct("role", F.col("text").alias("content")))
    return t.read("conversations").select(
        "conv_id", "turn", extract.completion_text(messages).alias("completion"))


@query("answer_span", with_views(
    r"""SELECT row_id, prefix_tokens, total_tokens,
        CASE WHEN prefix_tokens IS NULL OR prefix_tokens >= total_tokens THEN total_tokens
          ELSE total_tokens - prefix_tokens END AS answer_tokens,
        round(CASE WHEN prefix_tokens IS NULL OR prefix_tokens >= total_tokens THEN 1
          ELSE (total_tokens - prefix_tokens) / total_tokens END + 1e-12, 9) AS answer_share
        FROM (SELECT row_id, len(regexp_extract_all(text, '\S+')) AS total_tokens,
          CASE WHEN contains(text, 'Probability:') THEN len(regexp_extract_all(
            regexp_extract(text, '(?s)^(.*)Probability:', 1), '\S+')) END AS prefix_tokens
          FROM completions) s""", "completions"))
def answer_span(t: Tables):
    span = extract.answer_span(F.col("text"))
    return rounded(t.completions.select("row_id", span.alias("s")).select("row_id", "s.*"))


_P = "least(greatest(prob, 0.01), 0.99)"
_GOAL = "CASE WHEN row_id % 4 = 0 THEN outcome ELSE 0.5 * market + 0.5 * outcome END"
REWARDED = f"""SELECT row_id, group_id, outcome, text, prob IS NOT NULL AS format_ok,
    CASE WHEN prob IS NOT NULL THEN {_P} END AS prob,
    CASE WHEN prob IS NOT NULL THEN ({_P} - ({_GOAL})) ** 2 END AS brier,
    CASE WHEN prob IS NULL THEN -0.25
      ELSE 1 - ({_P} - ({_GOAL})) ** 2 END AS reward FROM
    ({S.extracted('completions', 'text', '*')}) e"""


def rewarded(t: Tables) -> DataFrame:
    target = F.when(F.col("row_id") % 4 != 0, F.col("market"))
    return with_probability(t.completions, name="p").withColumn("r", score_reward(
        F.col("p"), F.col("outcome"), target, blend=0.5, format_penalty=-0.25))


@query("score_reward", with_views(
    """SELECT row_id, format_ok, round(prob + 1e-12, 9) AS prob, round(brier + 1e-12, 9) AS brier,
       round(reward + 1e-12, 9) AS reward, round(abs(prob - 0.5) + 1e-12, 9) AS sharpness,
       round(1 - brier + 1e-12, 9) AS brier_reward FROM rewarded""", "completions", rewarded=REWARDED))
def score_rewards(t: Tables):
    return rounded(rewarded(t).select("row_id", "r.*"))


@query("score_reward_sharpness", with_views(
    f"""SELECT row_id, round(CASE WHEN prob IS NULL THEN 0
        ELSE (1 - ({_P} - outcome) ** 2) * (1 + 0.3 * abs({_P} - 0.5)) END + 1e-12, 9) AS reward
        FROM ({S.extracted('completions', 'text', '*')}) e""", "completions"))
def score_reward_sharpness(t: Tables):
    rows = reward_stage(sharpness_weight=0.3)(t.completions.select("row_id", "text", "outcome"))
    return rounded(rows.select("row_id", F.col("reward.reward").alias("reward")))


@query("variance_groups", with_views(
    """SELECT row_id, group_id, round(reward + 1e-12, 9) AS reward FROM rewarded WHERE group_id IN (
       SELECT group_id FROM rewarded GROUP BY group_id
       HAVING count(*) > 1 AND stddev_pop(reward) >= 0.3)""", "completions", rewarded=REWARDED))
def variance_group_rows(t: Tables):
    rewards = rewarded(t).select("row_id", "group_id", F.col("r.reward").alias("reward"))
    return rounded(variance_groups(rewards, min_std=0.3))


@query("audit_field_position", with_views(
    """SELECT row_id, CASE WHEN yardline_100 IS NULL THEN 'unknown'
       WHEN yardline_100 > 50 THEN concat('own ', 100 - yardline_100)
       WHEN yardline_100 = 50 THEN 'midfield (50)'
       WHEN yardline_100 <= 20 THEN concat('opponent ', yardline_100, ' (red zone)')
       ELSE concat('opponent ', yardline_100) END AS field FROM plays""", "plays"))
def audit_field_position(t: Tables):
    return _clause(t, audit.audit_field_position(F.col("yardline_100")), "field")


AUDIT_SCORE = """CASE WHEN score_differential > 0
  THEN concat(posteam, ' leading by ', score_differential) WHEN score_differential < 0
  THEN concat(posteam, ' trailing by ', -score_differential) ELSE 'tied' END"""


@query("audit_score_state", with_views(
    f"SELECT row_id, {AUDIT_SCORE} AS score FROM plays", "plays"))
def audit_score_state(t: Tables):
    return _clause(t, audit.audit_score_state(F.col("posteam"), F.col("score_differential")), "score")


SIDE = f"""CASE WHEN spread_line IS NULL THEN 'unknown' WHEN spread_line = 0 THEN 'pickem'
  WHEN {S.POSSESSION_LINE} > 0 THEN 'favored' ELSE 'underdog' END"""


@query("spread_struct", with_views(
    f"SELECT row_id, {SIDE} AS side, posteam AS team, abs(spread_line) AS points FROM plays", "plays"))
def spread_struct(t: Tables):
    line = audit.spread_struct(wording.render_prompt(), F.col("posteam"))
    return _clause(t, line, "s").select("row_id", "s.*")


PERIOD = "CASE WHEN qtr >= 5 THEN 'overtime' ELSE concat('Q', qtr) END"
AUDIT_FIELD = """CASE WHEN yardline_100 IS NULL THEN 'unknown'
  WHEN yardline_100 > 50 THEN concat('own ', 100 - yardline_100)
  WHEN yardline_100 = 50 THEN 'midfield (50)'
  WHEN yardline_100 <= 20 THEN concat('opponent ', yardline_100, ' (red zone)')
  ELSE concat('opponent ', yardline_100) END"""
TRUTH = f"""SELECT row_id, game_id, season, week, posteam, defteam, {PERIOD} AS period,
  time AS clock, {AUDIT_SCORE} AS score, score_differential, down, ydstogo,
  {AUDIT_FIELD} AS field_position, {SIDE} AS side, abs(spread_line) AS points,
  vegas_wp, vegas_wp AS target_prob, outcome AS actual_outcome FROM labelled"""


def truths(t: Tables) -> DataFrame:
    rows = qa_records(t.plays, ("row_id",))
    return computed_once(rows, truth=audit.ground_truth()).select("row_id", "truth")


@query("ground_truth", with_views("SELECT * FROM truth", "labelled", truth=TRUTH))
def ground_truth(t: Tables):
    flat = truths(t).select("row_id", "truth.*")
    return flat.select(*[c for c in flat.columns if c != "spread"], "spread.side", "spread.points")


@query("stratum", with_views(
    """SELECT row_id, CASE WHEN period = 'overtime' THEN 'OT' WHEN period IN ('Q1', 'Q2') THEN 'early'
       ELSE 'late' END AS phase, CASE WHEN abs(score_differential) <= 8 THEN 'close'
       ELSE 'lopsided' END AS leverage, side FROM truth""", "labelled", truth=TRUTH))
def strata(t: Tables):
    return truths(t).select("row_id", audit.stratum(F.col("truth")).alias("s")).select(
        "row_id", "s.*")
