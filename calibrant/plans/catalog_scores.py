"""Proper scores, calibration, coverage and comparisons on the same items."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibrant.operators import calibration as C
from calibrant.operators import cleaning, pairing
from calibrant.plans import sqltext as S
from calibrant.plans.fixtures import FORECASTERS, Tables, with_views
from calibrant.plans.registry import query, rounded
from calibrant.session import run_folder
from calibrant.sources import metrics as metric_source
from calibrant.sources import predictions as prediction_source

VARIANTS = [name for name, *_ in FORECASTERS]


def scored_sql(names, source="preds", **options):
    return with_views(S.metrics(names), "preds", stats=S.stats(source, **options))


def _metric(name: str):
    @query(name, scored_sql([name]))
    def run(t: Tables):
        return rounded(C.score(t.preds, [name]))


for _name in ("brier", "log_loss", "accuracy", "ece", "mce"):
    _metric(_name)

FLOOR_BIN = "least(CAST(floor(prob * 10) AS INT), 9)"
MURPHY = ["reliability", "resolution", "uncertainty", "brier_check"]


@query("ece_floor", scored_sql(["ece"], bin_sql=FLOOR_BIN))
def ece_floor(t: Tables):
    return rounded(C.score(t.preds, ["ece"], rule="floor"))


@query("murphy", scored_sql(MURPHY))
def murphy(t: Tables):
    return rounded(C.score(t.preds, MURPHY))


@query("reliability_curve", with_views(
    """SELECT v.variant, CAST(b.bin AS INT) AS bin, round(s.sp / s.n + 1e-12, 9) AS confidence,
       round(s.sy / s.n + 1e-12, 9) AS accuracy, coalesce(s.n, 0) AS n
       FROM (SELECT DISTINCT variant FROM stats) v CROSS JOIN generate_series(0, 24) b(bin)
       LEFT JOIN stats s ON s.variant = v.variant AND s.bin = b.bin""", "preds",
    stats=S.stats("preds", bin_sql=S.grid_bin("prob", 25))))
def reliability_curve(t: Tables):
    return rounded(C.reliability_curve(t.preds, n_bins=25))


@query("metrics_block", with_views(
    f"""SELECT m.*, c.bin_confidence, c.bin_accuracy, c.bin_count FROM
        ({S.metrics(['n', 'brier', 'log_loss', 'accuracy', 'ece', 'mce', *MURPHY])}) m
        JOIN (SELECT variant,
          string_agg(coalesce(printf('%.4f', sp / s.n), '-'), ' ' ORDER BY b) AS bin_confidence,
          string_agg(coalesce(printf('%.4f', sy / s.n), '-'), ' ' ORDER BY b) AS bin_accuracy,
          string_agg(CAST(coalesce(s.n, 0) AS VARCHAR), ' ' ORDER BY b) AS bin_count
          FROM (SELECT v.variant, b.b, s.* EXCLUDE (variant) FROM
            (SELECT DISTINCT variant FROM stats) v CROSS JOIN generate_series(0, 9) b(b)
            LEFT JOIN stats s ON s.variant = v.variant AND s.bin = b.b) s GROUP BY variant) c
        ON m.variant = c.variant""",
    "preds", stats=S.stats("preds")))
def metrics_block(t: Tables):
    """The whole block; the curve is shown as text here to compare it across engines."""
    block = C.metrics_block(t.preds)

    def text(values, decimals):
        shown = F.transform(values, lambda x: F.coalesce(
            F.format_string("%.4f", x) if decimals else x.cast("string"), F.lit("-")))
        return F.array_join(shown, " ")

    curve = F.col("reliability_curve")
    return rounded(block.select(
        "variant", "n", "brier", "log_loss", "accuracy", "ece", "mce", "murphy.*",
        text(curve["bin_confidence"], True).alias("bin_confidence"),
        text(curve["bin_accuracy"], True).alias("bin_accuracy"),
        text(curve["bin_count"], False).alias("bin_count")))


COVERAGE = """SELECT variant, count(*) AS n_total,
  round(avg(CAST(prob IS NOT NULL AND NOT coalesce(truncated, FALSE) AS INT)) + 1e-12, 9) AS coverage,
  round(avg(CAST(prob IS NOT NULL AS INT)) + 1e-12, 9) AS parse_rate,
  round(avg(CAST(coalesce(truncated, FALSE) AS INT)) + 1e-12, 9) AS truncation,
  round(avg(CAST(prob IS NOT NULL AND prob BETWEEN 0 AND 1 AS INT)) + 1e-12, 9) AS in_range,
  round(avg(chars) + 1e-12, 9) AS mean_completion_chars FROM preds GROUP BY variant"""


@query("coverage_report", with_views(COVERAGE, "preds"))
def coverage_report(t: Tables):
    return rounded(C.coverage_report(t.preds))


@query("validate_scores", with_views(
    """SELECT count(*) AS n, count(*) FILTER (WHERE prob IS NULL) AS missing_prob,
       count(*) FILTER (WHERE prob < 0 OR prob > 1) AS prob_out_of_range,
       count(*) FILTER (WHERE outcome IS NULL OR outcome NOT IN (0, 1)) AS outcome_not_binary
       FROM preds""", "preds"))
def validate_scores(t: Tables):
    return cleaning.score_violations(cleaning.validate_scores(t.preds, lenient=True))


@query("clean_predictions", with_views(
    "SELECT variant, row_id, prob FROM preds WHERE prob IS NOT NULL AND NOT coalesce(truncated, FALSE)",
    "preds"))
def clean_predictions(t: Tables):
    return cleaning.clean_predictions(t.preds).select("variant", "row_id", "prob")


@query("market_on_same_items", with_views(
    S.metrics(["n", "brier", "ece", "accuracy"]), "preds",
    clean="SELECT * FROM preds WHERE prob IS NOT NULL AND NOT coalesce(truncated, FALSE)",
    same="""SELECT variant, prob, outcome FROM clean
      UNION ALL SELECT concat(variant, ':market'), market, outcome FROM clean""", stats=S.stats("same")))
def market_on_same_items(t: Tables):
    return rounded(C.score(
        pairing.market_on_same_items(t.preds), ["n", "brier", "ece", "accuracy"]))


UNITED = """SELECT variant, row_id, prob, outcome FROM preds
  UNION ALL SELECT 'market', row_id, vegas_wp, outcome FROM labelled"""


@query("union_variants", with_views(f"SELECT * FROM ({UNITED}) u", "preds"))
def union_variants(t: Tables):
    return _united(t)


def _united(t: Tables):
    market = t.labelled.select(
        F.lit("market").alias("variant"), "row_id", F.col("vegas_wp").alias("prob"), "outcome")
    return pairing.union_variants(t.preds.select("variant", "row_id", "prob", "outcome"), market)


@query("leaderboard", with_views(
    f"""SELECT *, CASE variant WHEN 'zeroshot' THEN 1 WHEN 'masked' THEN 2 WHEN 'direct' THEN 3
        WHEN 'market' THEN 4 END AS place FROM ({S.metrics(['n', 'brier', 'ece'])}) m""",
    "preds", united=UNITED, stats=S.stats("united")))
def leaderboard(t: Tables):
    results = C.score(_united(t), ["n", "brier", "ece"])
    return rounded(C.leaderboard(results, ladder=["zeroshot", "masked", "direct", "market"]))


@query("best_checkpoint", with_views(
    f"""SELECT arg_min(variant, brier) AS variant, min(brier) AS brier
        FROM ({S.metrics(['brier'])}) m""", "preds", stats=S.stats("preds")))
def best_checkpoint(t: Tables):
    """Among the variants are one without a score and one whose score is NaN."""
    scores = C.score(t.preds, ["brier"])
    blank = t.spark.sql("""SELECT 'a blank' AS variant, CAST(NULL AS DOUBLE) AS brier
                           UNION ALL SELECT 'a NaN', CAST('NaN' AS DOUBLE)""")
    return rounded(C.best_checkpoint(scores.unionByName(blank)))


_SIDES = """SELECT a.row_id, a.prob AS a, b.prob AS b, a.market, a.outcome
  FROM preds a JOIN preds b ON a.row_id = b.row_id
  WHERE a.variant = 'direct' AND b.variant = 'masked'"""
PAIRED = f"SELECT * FROM ({_SIDES}) s WHERE a IS NOT NULL AND b IS NOT NULL"


@query("paired_join", with_views(f"SELECT * FROM ({_SIDES}) s", "preds"))
def paired_join(t: Tables):
    return pairing.paired_join(t.preds, "direct", "masked", both_parsed=False)


@query("both_parsed", with_views(PAIRED, "preds"))
def both_parsed(t: Tables):
    return pairing.paired_join(t.preds, "direct", "masked")


@query("align_models", with_views(
    """SELECT row_id, max(outcome) AS outcome, max(prob) FILTER (WHERE variant = 'direct') AS direct,
       max(prob) FILTER (WHERE variant = 'masked') AS masked,
       max(prob) FILTER (WHERE variant = 'zeroshot') AS zeroshot,
       count(*) = 3 AND min(outcome) = max(outcome) AS aligned FROM kept GROUP BY row_id""",
    "preds", kept="SELECT * FROM preds WHERE NOT (variant = 'masked' AND row_id % 13 = 0)"))
def align_models(t: Tables):
    missing = (F.col("variant") == "masked") & (F.col("row_id") % 13 == 0)
    return pairing.align_models(t.preds.where(~missing), VARIANTS)


_FAULTY = """SELECT variant, row_id, prob, market,
    CASE WHEN row_id % 23 = 1 AND variant = 'masked' THEN 1 - outcome ELSE outcome END AS outcome
  FROM preds WHERE NOT (variant = 'direct' AND row_id % 17 = 2)
    AND NOT (variant = 'masked' AND row_id % 19 = 3)
  UNION ALL SELECT variant, row_id, prob, market, outcome FROM preds
  WHERE variant = 'direct' AND row_id % 29 = 4"""


def _faulty(t: Tables):
    """Predictions with every fault of alignment: items missing, repeated, of another outcome."""
    variant, row = F.col("variant"), F.col("row_id")
    missing = ((variant == "direct") & (row % 17 == 2)) | ((variant == "masked") & (row % 19 == 3))
    other = (row % 23 == 1) & (variant == "masked")
    rows = t.preds.select("variant", "row_id", "prob", "market", "outcome")
    changed = rows.where(~missing).withColumn(
        "outcome", F.when(other, 1 - F.col("outcome")).otherwise(F.col("outcome")))
    return changed.unionByName(rows.where((variant == "direct") & (row % 29 == 4)))


@query("pairing_violations", with_views(
    """SELECT row_id, CASE WHEN n_a > 1 OR n_b > 1 THEN 'repeated'
         WHEN n_a = 0 THEN 'not in the first' WHEN n_b = 0 THEN 'not in the second'
         ELSE 'outcomes differ' END AS fault FROM (
       SELECT row_id, count(*) FILTER (WHERE variant = 'direct') AS n_a,
         count(*) FILTER (WHERE variant = 'masked') AS n_b,
         min(outcome) <> max(outcome) AS differs FROM faulty
       WHERE variant IN ('direct', 'masked') GROUP BY row_id) s
       WHERE n_a <> 1 OR n_b <> 1 OR differs""", "preds", faulty=_FAULTY))
def pairing_violations(t: Tables):
    return pairing.pairing_violations(_faulty(t), "direct", "masked")


@query("aligned_models", with_views(
    """SELECT row_id, max(outcome) AS outcome, max(prob) FILTER (WHERE variant = 'direct') AS direct,
       max(prob) FILTER (WHERE variant = 'masked') AS masked,
       max(prob) FILTER (WHERE variant = 'zeroshot') AS zeroshot
       FROM preds GROUP BY row_id""", "preds"))
def aligned_models(t: Tables):
    return pairing.aligned_models(t.preds, VARIANTS)


@query("features_join", with_views(
    """SELECT p.variant, p.row_id, p.prob, p.outcome, f.yardline_100, f.score_differential,
       p.outcome = f.outcome AS outcome_agrees FROM preds p LEFT JOIN labelled f
       ON p.row_id = f.row_id""", "preds"))
def features_join(t: Tables):
    scored = t.preds.select("variant", "row_id", "prob", "outcome")
    features = t.labelled.select("row_id", "outcome", "yardline_100", "score_differential")
    return pairing.features_join(scored, features, outcome="outcome")


@query("features_join_gaps", with_views(
    """SELECT p.row_id, p.prob, p.outcome, f.yardline_100, coalesce(p.outcome = f.outcome, FALSE)
       AS outcome_agrees FROM preds p LEFT JOIN
       (SELECT row_id, CASE WHEN row_id % 7 = 1 THEN 1 - outcome ELSE outcome END AS outcome,
          yardline_100 FROM labelled WHERE row_id % 5 <> 0) f ON p.row_id = f.row_id
       WHERE p.variant = 'direct'""", "preds"))
def features_join_gaps(t: Tables):
    """Rows without features, or with another outcome, stay when asked for."""
    scored = t.preds.where(F.col("variant") == "direct").select("row_id", "prob", "outcome")
    outcome = F.when(F.col("row_id") % 7 == 1, 1 - F.col("outcome")).otherwise(F.col("outcome"))
    features = t.labelled.where(F.col("row_id") % 5 != 0).select(
        "row_id", outcome.alias("outcome"), "yardline_100")
    return pairing.features_join(scored, features, outcome="outcome", strict=False)


_PREDS = "SELECT variant, row_id, game_id, prob, outcome, market, truncated FROM preds"


@query("read_prediction_maps", with_views(_PREDS, "preds"))
def read_prediction_maps(t: Tables):
    lines = prediction_source.prediction_map_lines(t.preds)
    return prediction_source.parse_prediction_maps(lines).select(
        "variant", "row_id", "game_id", "prob", "outcome", "market", "truncated")


@query("write_prediction_maps", with_views(_PREDS, "preds"))
def write_prediction_maps(t: Tables):
    path = run_folder(t.spark, "maps")
    prediction_source.write_prediction_maps(t.preds, path)
    return prediction_source.read_prediction_maps(t.spark, path).select(
        "variant", "row_id", "game_id", "prob", "outcome", "market", "truncated")


@query("write_predictions", with_views(f"{_PREDS}", "preds"))
def write_predictions(t: Tables):
    path = run_folder(t.spark, "predictions")
    prediction_source.write_predictions(t.preds, path)
    return t.spark.read.parquet(path).select(
        "variant", "row_id", "game_id", "prob", "outcome", "market", "truncated")


@query("metrics_sink", scored_sql(["n", "brier", "ece"]))
def metrics_sink(t: Tables):
    path = run_folder(t.spark, "metrics")
    metric_source.write_metrics(rounded(C.score(t.preds, ["n", "brier", "ece"])), path)
    return t.spark.read.schema("variant string, n bigint, brier double, ece double").json(path)
