"""Scans, labels, records, splits, targets and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from calibrant.functions.audit import ground_truth, stratum
from calibrant.functions.labels import difficulty, possession_outcome, season_split
from calibrant.functions.numbers import fixed_text
from calibrant.functions.wording import possession_line, prompt_mode, render_prompt
from calibrant.operators import cleaning, records, sampling
from calibrant.operators.rates import (
    RateKey, backoff_lookup, coarser, rate_counts, rate_table, state_keys,
)
from calibrant.operators.calibration import score
from calibrant.operators.pairing import long_forecasts
from calibrant.operators.staging import computed_once
from calibrant.plans import sqltext as S
from calibrant.plans.fixtures import EVAL_SEASONS, TEST_SEASONS, Tables, with_views
from calibrant.plans.registry import query, rounded
from calibrant.schemas import PLAY_COLUMNS, QA_RECORD
from calibrant.session import run_folder
from calibrant.sources import plays as play_source
from calibrant.sources import records as record_source

F_SPLIT = "CASE WHEN season = 2000 THEN 'eval' WHEN season = 2001 THEN 'test' ELSE 'train' END"


def fine_keys() -> list[RateKey]:
    line = possession_line(F.col("spread_line"), F.col("posteam"), F.col("home_team"))
    return state_keys(
        F.col("score_differential"), F.col("game_seconds_remaining"),
        F.coalesce(line, F.lit(0.0)), F.coalesce("yardline_100", F.lit(50)),
        F.coalesce("down", F.lit(0)))


def coarse_keys() -> list[RateKey]:
    return fine_keys()[:3]


def fitted(t: Tables, keys: list[RateKey]) -> DataFrame:
    """The rate table of the training rows, written once."""
    return rate_table(t.labelled.where(F.col("split") == "train"), keys)


@query("scan_required_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_required_columns(t: Tables):
    return play_source.scan_plays(
        t.spark, t.path("orders"), required=["o_orderkey", "o_custkey", "o_totalprice"])


@query("season_filter", with_views(
    "SELECT row_id, season FROM plays WHERE season IN (1996, 1997, 2000)", "plays"))
def season_filter(t: Tables):
    return play_source.season_filter(t.plays, "1996-1997,2000").select("row_id", "season")


_NAN_EPA = "CASE WHEN row_id % 37 = 0 THEN NULL ELSE epa END"


@query("write_plays_parquet", with_views(
    f"SELECT {', '.join(['row_id', *(c for c in PLAY_COLUMNS if c != 'epa')])}, {_NAN_EPA} AS epa"
    " FROM plays", "plays"))
def write_plays_parquet(t: Tables):
    """All seasons and columns, with a column that comes as NaN here and there."""
    path = run_folder(t.spark, "plays")
    epa = F.when(F.col("row_id") % 37 == 0, F.lit(float("nan"))).otherwise(F.col("epa"))
    play_source.write_plays(t.plays.withColumn("epa", epa), path)
    return play_source.scan_plays(t.spark, path, required=["row_id", *PLAY_COLUMNS])


@query("clean_plays", with_views(
    """SELECT row_id, down, vegas_wp FROM plays WHERE posteam IS NOT NULL AND defteam IS NOT NULL
       AND vegas_wp IS NOT NULL AND result IS NOT NULL AND down IS NOT NULL
       AND game_seconds_remaining IS NOT NULL""", "plays"))
def clean_plays(t: Tables):
    return cleaning.clean_plays(t.plays).select("row_id", "down", "vegas_wp")


@query("kept_ratio", with_views(
    """SELECT count(*) FILTER (WHERE vegas_wp IS NOT NULL AND down IS NOT NULL) AS kept,
       count(*) AS total,
       round(count(*) FILTER (WHERE vegas_wp IS NOT NULL AND down IS NOT NULL) / count(*) + 1e-12, 9)
       AS share FROM plays""", "plays"))
def kept_ratio(t: Tables):
    return rounded(cleaning.kept_ratio(t.plays))


@query("possession_outcome", with_views(
    """SELECT row_id, CASE WHEN result = 0 THEN NULL WHEN posteam = home_team
       THEN CAST(result > 0 AS INT) ELSE CAST(result < 0 AS INT) END AS outcome FROM plays""",
    "plays"))
def outcome(t: Tables):
    return t.plays.select("row_id", possession_outcome(
        F.col("result"), F.col("posteam"), F.col("home_team")).alias("outcome"))


@query("difficulty", with_views(
    "SELECT row_id, round(1 - abs(2 * vegas_wp - 1) + 1e-12, 9) AS difficulty FROM plays", "plays"))
def difficulties(t: Tables):
    return rounded(t.plays.select("row_id", difficulty(F.col("vegas_wp")).alias("difficulty")))


@query("season_split", with_views(f"SELECT row_id, season, {F_SPLIT} AS split FROM plays", "plays"))
def splits(t: Tables):
    split = season_split(F.col("season"), EVAL_SEASONS, TEST_SEASONS)
    return t.plays.select("row_id", "season", split.alias("split"))


@query("split_disjointness", with_views(
    """SELECT group_id, count(DISTINCT split) AS splits, count(*) AS rows FROM plays
       GROUP BY group_id HAVING count(DISTINCT split) > 1""", "plays"))
def split_disjointness(t: Tables):
    return cleaning.split_overlaps(t.plays)


def _qa(t: Tables) -> DataFrame:
    return records.qa_records(t.plays, ("row_id", "split"))


QA_FLAT = """row_id, question, target_prob, actual_outcome, game_id, season, week,
  difficulty, posteam, qtr, time, game_seconds_remaining, down, ydstogo, yardline_100,
  score_differential, epa, spread_line"""
QA_CHECK = with_views(f"SELECT {QA_FLAT} FROM qa", "labelled", qa=f"""
  SELECT row_id, {S.PROMPT} AS question, vegas_wp AS target_prob, outcome AS actual_outcome, game_id,
  season, week, round(1 - abs(2 * vegas_wp - 1) + 1e-12, 9) AS difficulty, posteam, qtr, time,
  game_seconds_remaining, down, ydstogo, yardline_100, score_differential, epa, spread_line
  FROM labelled""")


def _qa_flat(qa: DataFrame) -> DataFrame:
    return rounded(qa.select(
        "row_id", "question", "target_prob", "actual_outcome", "game_id", "season", "week",
        "difficulty", "features.posteam", "features.qtr", "features.time",
        "features.game_seconds_remaining", "features.down", "features.ydstogo",
        "features.yardline_100", "features.score_differential", "features.epa",
        "features.spread_line"))


@query("qa_records", QA_CHECK)
def qa_records(t: Tables):
    return _qa_flat(_qa(t))


@query("read_jsonl", QA_CHECK)
def read_jsonl(t: Tables):
    path = run_folder(t.spark, "qa")
    record_source.write_jsonl(_qa(t), path)
    schema = StructType([*QA_RECORD.fields, StructField("row_id", LongType())])
    return _qa_flat(record_source.read_jsonl(t.spark, path, schema))


@query("write_split_jsonl", with_views(
    f"""SELECT row_id, split, {S.PROMPT} AS prompt, outcome AS actual_outcome, vegas_wp, game_id,
        season, round(1 - abs(2 * vegas_wp - 1) + 1e-12, 9) AS difficulty, week
        FROM labelled WHERE NOT contains({S.PROMPT}, printf('%.2f', vegas_wp))""", "labelled"))
def write_split_jsonl(t: Tables):
    """Every training record as it comes back; the guard lets none through that leaks."""
    slim = records.training_projection(_qa(t), ("row_id", "split"))
    clean = slim.where(~F.contains("prompt", fixed_text(F.col("vegas_wp"), 2)))
    path = run_folder(t.spark, "splits")
    record_source.write_split_jsonl(clean, path)
    back = t.spark.read.schema(slim.schema).json(path)
    return rounded(back.select("row_id", "split", "prompt", "actual_outcome", "vegas_wp", "game_id",
                               "season", "difficulty", "meta.week"))


@query("split_counts", with_views(
    "SELECT split, count(*) AS records FROM labelled GROUP BY split", "labelled"))
def split_counts(t: Tables):
    return record_source.split_counts(_qa(t))


@query("training_projection", with_views(
    f"""SELECT row_id, {S.PROMPT} AS prompt, outcome AS actual_outcome, vegas_wp, game_id, season,
        round(1 - abs(2 * vegas_wp - 1) + 1e-12, 9) AS difficulty, qtr, score_differential,
        game_seconds_remaining, week FROM labelled""", "labelled"))
def training_projection(t: Tables):
    slim = records.training_projection(_qa(t), ("row_id",))
    return rounded(slim.select("row_id", "prompt", "actual_outcome", "vegas_wp", "game_id",
                               "season", "difficulty", "meta.*"))


@query("leak_guard", with_views(
    """SELECT row_id, CASE WHEN contains(lower(prompt), 'vegas') THEN 'term'
         WHEN contains(prompt, printf('%.2f', vegas_wp)) THEN 'value' END AS leak
       FROM prompts""", "labelled", prompts=f"""
       SELECT row_id, vegas_wp, concat({S.PROMPT}, CASE WHEN row_id % 29 = 0 THEN ' VEGAS agrees'
         WHEN row_id % 31 = 0 THEN concat(' near ', printf('%.2f', vegas_wp)) ELSE '' END) AS prompt
       FROM labelled"""))
def leak_guard(t: Tables):
    """The violations, and through the guard every row that has none."""
    spoiled = F.when(F.col("row_id") % 29 == 0, " VEGAS agrees").when(
        F.col("row_id") % 31 == 0, F.concat(F.lit(" near "), fixed_text(F.col("vegas_wp"), 2))
    ).otherwise("")
    prompts = computed_once(t.labelled, prompt=F.concat(render_prompt(), spoiled))
    checked = computed_once(prompts, leak=cleaning.leak_reason(F.col("prompt"), F.col("vegas_wp")))
    guarded = cleaning.leak_guard(checked.where(F.col("leak").isNull()))
    return cleaning.leak_violations(prompts).select("row_id", "leak").unionByName(
        guarded.select("row_id", "leak"))


@query("leak_guard_documents", """SELECT doc_id, 'term' AS leak FROM documents
  WHERE contains(lower(text), 'answer') OR contains(lower(text), 'license')""")
def leak_guard_documents(t: Tables):
    docs = t.read("documents").withColumn("hidden", F.lit(None).cast("double"))
    return cleaning.leak_violations(docs, "text", "hidden", ["Answer", "License"]).select(
        "doc_id", "leak")


@query("trainer_frame", with_views(
    f"""SELECT row_id, 'user' AS role, replace({S.PROMPT}, '{S.STEP_BY_STEP}',
        'Respond with ONLY the win probability as a percentage and nothing else (for example: 63%).')
        AS content, outcome AS actual_outcome, wp AS target FROM labelled""", "labelled"))
def trainer_frame(t: Tables):
    slim = records.training_projection(
        records.qa_records(t.plays, ("row_id", "wp")), ("row_id", F.col("wp").alias("target")))
    rows = records.trainer_frame(slim, "direct", ("row_id",))
    return rows.select("row_id", F.inline("prompt"), "actual_outcome", "target")


@query("prompt_mode", with_views(
    f"""SELECT row_id, m.mode, replace({S.PROMPT}, '{S.STEP_BY_STEP}', m.wanted) AS prompt
        FROM labelled CROSS JOIN (VALUES ('cot', '{S.STEP_BY_STEP}'),
        ('direct', 'Respond with ONLY the win probability as a percentage and nothing else (for example: 63%).'),
        ('masked', 'Reason step by step. Then, on a new line, give your final answer in exactly this format: Probability: NN%   (NN = the win probability).'))
        m(mode, wanted)""", "labelled"))
def prompt_modes(t: Tables):
    modes = F.explode(F.array(*[F.lit(m) for m in ("cot", "direct", "masked")]))
    rows = t.labelled.select("row_id", render_prompt().alias("prompt"), modes.alias("mode"))
    return rows.withColumn("prompt", prompt_mode(F.col("prompt"), F.col("mode")))


@query("stride_sample", with_views(
    """SELECT row_id, game_id FROM (SELECT row_id, game_id,
       row_number() OVER (ORDER BY season, row_id) - 1 AS i FROM plays) s WHERE i % 8 = 0""", "plays"))
def stride_sample(t: Tables):
    rows = t.plays.select("season", "row_id", "game_id")
    return sampling.stride_sample(rows, 8, ["season", "row_id"]).select("row_id", "game_id")


@query("take_first_n", with_views(
    "SELECT row_id, season FROM plays ORDER BY row_id LIMIT 128", "plays"))
def take_first_n(t: Tables):
    return sampling.take_first_n(t.plays, 128, ["row_id"]).select("row_id", "season")


TIED = ["season", "qtr"]


@query("take_first_n_ties", with_views(
    """SELECT season, qtr, count(*) AS rows_taken FROM (
       SELECT season, qtr FROM plays ORDER BY season NULLS FIRST, qtr NULLS FIRST LIMIT 1000) s
       GROUP BY season, qtr""", "plays"))
def take_first_n_ties(t: Tables):
    """An order with many ties: which tied rows come is a matter of a hash, how many is not."""
    return sampling.take_first_n(t.plays, 1000, TIED).groupBy(*TIED).agg(
        F.count(F.lit(1)).alias("rows_taken"))


@query("stride_sample_ties", with_views(
    """SELECT season, qtr, count(*) AS rows_taken FROM (SELECT season, qtr,
       row_number() OVER (ORDER BY season NULLS FIRST, qtr NULLS FIRST) - 1 AS i FROM plays) s
       WHERE i % 8 = 0 GROUP BY season, qtr""", "plays"))
def stride_sample_ties(t: Tables):
    return sampling.stride_sample(t.plays, 8, TIED).groupBy(*TIED).agg(
        F.count(F.lit(1)).alias("rows_taken"))


@query("seeded_sample_n", with_views(
    """SELECT row_id, outcome FROM labelled
       ORDER BY md5(concat('1234|', CAST(row_id AS STRING))), row_id LIMIT 128""", "labelled"))
def seeded_sample_n(t: Tables):
    rows = t.labelled.select("row_id", "outcome")
    return sampling.seeded_sample_n(rows, 128, "row_id", 1234).orderBy("row_id")


STRATA_SQL = """CASE WHEN qtr >= 5 THEN 'OT' WHEN qtr <= 2 THEN 'early' ELSE 'late' END AS phase,
  CASE WHEN abs(score_differential) <= 8 THEN 'close' ELSE 'lopsided' END AS leverage,
  CASE WHEN spread_line IS NULL THEN 'unknown' WHEN spread_line = 0 THEN 'pickem'
    WHEN (spread_line > 0) = (posteam = home_team) THEN 'favored' ELSE 'underdog' END AS side"""


def with_strata(t: Tables) -> DataFrame:
    truth = _qa(t).select("row_id", ground_truth().alias("truth"))
    return truth.select("row_id", stratum(F.col("truth")).alias("s")).select("row_id", "s.*")


SAMPLED = """SELECT row_id, phase, leverage, side FROM (SELECT *,
    row_number() OVER (PARTITION BY phase, leverage, side
      ORDER BY md5(concat('0|', CAST(row_id AS STRING))), row_id) AS turn,
    count(*) OVER (PARTITION BY phase, leverage, side) AS size FROM strata) q
  ORDER BY turn, size DESC, phase, leverage, side LIMIT 250"""


@query("stratified_sample", with_views(
    SAMPLED, "labelled", strata=f"SELECT row_id, {STRATA_SQL} FROM labelled"))
def stratified_sample(t: Tables):
    return sampling.stratified_sample(
        with_strata(t), 250, ["phase", "leverage", "side"], "row_id", 0)


@query("strata_counts", with_views(
    f"""SELECT phase, leverage, side, count(*) AS n FROM ({SAMPLED}) q
        GROUP BY phase, leverage, side""",
    "labelled", strata=f"SELECT row_id, {STRATA_SQL} FROM labelled"))
def strata_counts(t: Tables):
    return stratified_sample(t).groupBy("phase", "leverage", "side").agg(
        F.count(F.lit(1)).alias("n"))


def _level_rows(names: list[str]) -> str:
    parts = []
    for depth in range(len(names) + 1):
        keys = ", ".join(k if i < depth else f"CAST(NULL AS INT) AS {k}"
                         for i, k in enumerate(names))
        parts.append(f"SELECT {depth} AS level, {keys}, wins, n, round(phat + 1e-12, 9) AS phat"
                     f" FROM f{depth}")
    return " UNION ALL ".join(parts)


@query("rate_table", with_views(
    _level_rows(S.FINE), "labelled", keyed=S.keyed(), **S.rate_levels("f", S.FINE)))
def rate_tables(t: Tables):
    return rounded(rate_table(t.labelled.where(F.col("split") == "train"), fine_keys()))


@query("rate_counts", with_views(
    """SELECT coalesce(CAST(score_bin AS STRING), '*') AS score_bin,
       coalesce(CAST(time_bin AS STRING), '*') AS time_bin,
       coalesce(CAST(spread_bin AS STRING), '*') AS spread_bin,
       CAST(sum(outcome) AS BIGINT) AS wins, count(*) AS n FROM keyed
       GROUP BY ROLLUP (score_bin, time_bin, spread_bin)""", "labelled", keyed=S.keyed()))
def rate_count(t: Tables):
    counts = rate_counts(t.labelled, coarse_keys())
    shown = [F.coalesce(F.col(k).cast("string"), F.lit("*")).alias(k) for k in S.COARSE]
    return counts.select(*shown, "wins", "n")


@query("edge_bin", with_views(
    f"SELECT row_id, {', '.join(S.FINE)} FROM keyed", "labelled", keyed=S.keyed()))
def edge_bins(t: Tables):
    return t.labelled.select("row_id", *[k.column.alias(k.name) for k in fine_keys()])


@query("backoff_lookup", with_views(
    S.looked_up("f", S.FINE, "(SELECT * FROM keyed WHERE split <> 'train')",
                "r.row_id, r.outcome", "phat", 5),
    "labelled", keyed=S.keyed(), **S.rate_levels("f", S.FINE)))
def lookups(t: Tables):
    held_out = t.labelled.where(F.col("split") != "train")
    keys = fine_keys()
    return backoff_lookup(held_out, fitted(t, keys), keys, decimals=5).select(
        "row_id", "outcome", "phat", "phat_level")


def _with_targets(t: Tables) -> list[tuple[str, DataFrame, list[RateKey]]]:
    fine, coarse = fine_keys(), coarse_keys()
    table = fitted(t, fine)
    return [("target", coarser(table, coarse), coarse), ("target_fine", table, fine)]


TARGETS_CHECK = {
    "keyed": S.keyed(), **S.rate_levels("c", S.COARSE), **S.rate_levels("f", S.FINE),
    "coarse": S.looked_up("c", S.COARSE, "keyed", "r.row_id, r.split, r.outcome, r.vegas_wp",
                          "target", 5),
    "fine": S.looked_up("f", S.FINE, "keyed", "r.row_id", "target_fine", 5),
}


@query("attach_targets_rewrite", with_views(
    """SELECT c.row_id, c.split, c.target, f.target_fine FROM coarse c
       JOIN fine f ON c.row_id = f.row_id""", "labelled", **TARGETS_CHECK))
def attach_targets_rewrite(t: Tables):
    path = run_folder(t.spark, "targets")
    record_source.rewrite_with_targets(t.labelled, _with_targets(t), path)
    schema = "row_id bigint, target double, target_fine double, split string"
    return t.spark.read.schema(schema).json(path)


@query("teacher_report", with_views(
    S.metrics(["n", "brier", "ece"]), "labelled", **TARGETS_CHECK,
    forecasts="""SELECT 'coarse' AS variant, target AS prob, outcome FROM coarse WHERE split = 'eval'
      UNION ALL SELECT 'fine', f.target_fine, c.outcome FROM coarse c
      JOIN fine f ON c.row_id = f.row_id WHERE c.split = 'eval'
      UNION ALL SELECT 'market', vegas_wp, outcome FROM coarse WHERE split = 'eval'""",
    stats=S.stats("forecasts")))
def teacher_report(t: Tables):
    held_out = t.labelled.where(F.col("split") == "eval")
    rows = record_source.attach_targets(held_out, _with_targets(t))
    forecasts = long_forecasts(rows, {
        "coarse": F.col("target"), "fine": F.col("target_fine"), "market": F.col("vegas_wp"),
    }, ["outcome"])
    return rounded(score(forecasts, ["n", "brier", "ece"]))


FLAGSHIP = with_views(
    S.metrics(["n", "brier", "log_loss", "accuracy", "ece", "mce", "reliability", "resolution",
               "uncertainty", "brier_check"]),
    "labelled", keyed=S.keyed(), **S.rate_levels("c", S.COARSE),
    coarse=S.looked_up("c", S.COARSE, "(SELECT * FROM keyed WHERE split = 'test')",
                       "r.outcome, r.vegas_wp", "target"),
    forecasts="""SELECT 'rate' AS variant, target AS prob, outcome FROM coarse
      UNION ALL SELECT 'market', vegas_wp, outcome FROM coarse""",
    stats=S.stats("forecasts"))


@query("calibration_report", FLAGSHIP)
def calibration_report(t: Tables):
    """Rates fitted on the training seasons against the market on the test season.

    From the raw plays: labels, splits, rates, look-ups and scores are all the library's.
    """
    keys = coarse_keys()
    plays = t.plays.withColumns({
        "outcome": possession_outcome(F.col("result"), F.col("posteam"), F.col("home_team")),
        "split": season_split(F.col("season"), EVAL_SEASONS, TEST_SEASONS),
    }).dropna(subset=["outcome", "vegas_wp"])
    table = rate_table(plays.where(F.col("split") == "train"), keys)
    rows = backoff_lookup(plays.where(F.col("split") == "test"), table, keys, "target")
    forecasts = long_forecasts(
        rows, {"rate": F.col("target"), "market": F.col("vegas_wp")}, ["outcome"])
    return rounded(score(forecasts))
