"""Resampling intervals, at the number of replicates that they have by default."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibrant.operators import calibration, pairing
from calibrant.operators import resampling as R
from calibrant.operators import resampling_exact as X
from calibrant.plans import sqltext as S
from calibrant.plans.catalog_scores import PAIRED
from calibrant.plans.fixtures import Tables, with_views
from calibrant.plans.registry import query, rounded

REPS = 2000
PAIRED_REPS = 10_000
SCORED = f"""SELECT variant, {S.grid_bin('prob')} AS bin, prob AS p, outcome AS y,
  (prob - outcome) ** 2 AS sq, row_id FROM preds WHERE prob IS NOT NULL AND outcome IS NOT NULL"""


_INTERVALS = f"""SELECT variant, {S.interval('brier', 'brier_')}, {S.interval('ece', 'ece_')} FROM (
  SELECT variant, rep, sum(sq) / sum(weight) AS brier, sum(abs(p - y)) / sum(weight) AS ece
  FROM sums GROUP BY variant, rep) r GROUP BY variant"""


@query("replicate_cross", with_views(
    "SELECT variant, rep, weight, round(p, 6) AS p, round(sq, 6) AS sq FROM sums", "preds",
    scored=SCORED, sums=S.replicate_sums("scored", "variant, ", ["p", "sq"], REPS)))
def replicate_cross(t: Tables):
    p, y = F.col("prob"), F.col("outcome")
    scored = t.preds.where(p.isNotNull()).select(
        "variant", "row_id", p.alias("p"), ((p - y) * (p - y)).alias("sq"))
    sums = R.replicate_sums(scored, ["variant"], ["p", "sq"])
    return rounded(sums.where(F.col("rep") >= 0), 6)


def _intervals_sql(bins: int) -> str:
    scored = SCORED.replace(S.grid_bin("prob"), S.grid_bin("prob", bins))
    return with_views(
        f"""SELECT * FROM ({_INTERVALS}) i
            JOIN ({S.metrics(['brier', 'ece'])}) m USING (variant)""", "preds",
        stats=S.stats("preds", bin_sql=S.grid_bin("prob", bins)), scored=scored,
        sums=S.replicate_sums("scored", "variant, bin, ", ["p", "y", "sq"], REPS))


@query("bootstrap_ci", _intervals_sql(10))
def bootstrap_ci(t: Tables):
    return rounded(R.bootstrap_ci(t.preds))


@query("bootstrap_ci_cells", _intervals_sql(4))
def bootstrap_ci_cells(t: Tables):
    """With bins of another width."""
    return rounded(R.bootstrap_ci(t.preds, n_bins=4))


@query("bootstrap_median", with_views(
    f"""SELECT variant, round(max(CASE WHEN rep < 0 THEN median END) + 1e-12, 9) AS median,
        {S.interval('CASE WHEN rep >= 0 THEN median END', 'median_')} FROM (
          SELECT variant, rep, avg(x) AS median FROM (
            SELECT *, sum(weight) OVER (PARTITION BY variant, rep ORDER BY x) AS upto,
              sum(weight) OVER (PARTITION BY variant, rep) AS whole FROM both_ WHERE weight > 0) w
          WHERE upto >= floor((whole + 1) / 2) AND upto - weight < floor(whole / 2) + 1
          GROUP BY variant, rep) r GROUP BY variant""", "preds",
    lengths="SELECT variant, chars AS x, row_id FROM preds",
    sums=S.replicate_sums("lengths", "variant, x, ", ["x"], REPS).replace(
        "sum(CAST(x AS DOUBLE)) AS x", "max(x) AS _x").replace("sum(w * x) AS x", "max(_x) AS _x"),
    both_="""SELECT variant, x, rep, weight FROM sums UNION ALL
      SELECT variant, x, -1, count(*) FROM lengths GROUP BY variant, x"""))
def bootstrap_median(t: Tables):
    """A statistic that is no function of sums."""
    median = F.percentile("x", F.lit(0.5), F.col("weight").cast("bigint"))
    return rounded(R.bootstrap_statistics(
        t.preds, ["variant"], {}, {"median": median},
        {"x": F.col("chars")}))


QUARTILES = (0.25, 0.5, 0.75)


def _quantile_sql(q: float) -> str:
    """Per replicate the rows at both sides of rank q (W - 1), interpolated."""
    return f"""SELECT variant, rep, CAST({q} AS DOUBLE) AS quantile, any_value(whole) AS whole,
      max(x) FILTER (WHERE upto - weight <= floor({q} * (whole - 1))
        AND upto > floor({q} * (whole - 1))) AS below,
      max(x) FILTER (WHERE upto - weight <= ceil({q} * (whole - 1))
        AND upto > ceil({q} * (whole - 1))) AS above,
      any_value({q} * (whole - 1) - floor({q} * (whole - 1))) AS share
      FROM ranked GROUP BY variant, rep"""


@query("bootstrap_quantiles", with_views(
    """SELECT variant, quantile, CAST(max(whole) FILTER (rep < 0) AS BIGINT) AS n,
       round(max(below + (above - below) * share) FILTER (rep < 0) + 1e-12, 6) AS estimate,
       round(quantile_cont(below + (above - below) * share, 0.025) FILTER (rep >= 0) + 1e-12, 6) AS lo,
       round(quantile_cont(below + (above - below) * share, 0.975) FILTER (rep >= 0) + 1e-12, 6) AS hi
       FROM found GROUP BY variant, quantile""", "preds",
    lengths="SELECT variant, chars AS x, row_id FROM preds WHERE chars IS NOT NULL",
    sums=S.replicate_sums("lengths", "variant, x, ", ["x"], REPS).replace(
        "sum(CAST(x AS DOUBLE)) AS x", "max(x) AS _x").replace("sum(w * x) AS x", "max(_x) AS _x"),
    both_="""SELECT variant, x, rep, weight FROM sums UNION ALL
      SELECT variant, x, -1, count(*) FROM lengths GROUP BY variant, x""",
    ranked="""SELECT *, sum(weight) OVER (PARTITION BY variant, rep ORDER BY x) AS upto,
      sum(weight) OVER (PARTITION BY variant, rep) AS whole FROM both_ WHERE weight > 0""",
    found=" UNION ALL ".join(_quantile_sql(q) for q in QUARTILES)))
def bootstrap_quantiles(t: Tables):
    """Quartiles from sketches of the buckets: no value meets a replicate."""
    return rounded(X.quantile_intervals(t.preds, ["variant"], "chars", QUARTILES), 6)


@query("bootstrap_exact_n", with_views(
    f"""SELECT variant, rep, CAST(count(*) AS DOUBLE) AS weight FROM scored
        CROSS JOIN (SELECT unnest(range(-1, {REPS})) AS rep) r GROUP BY variant, rep""", "preds", scored=SCORED))
def bootstrap_exact_n(t: Tables):
    """Every replicate draws exactly the number of rows of its variant, in whole rows of each cell."""
    p, y = F.col("prob"), F.col("outcome")
    scored = t.preds.where(p.isNotNull() & y.isNotNull()).select("variant", p.alias("p"), y.alias("y"))
    cells = X.multinomial_sums(scored, ["variant"], ["p"], ["y"], REPS)
    return cells.where(F.col("weight") == F.floor("weight")).groupBy("variant", "rep").agg(
        F.sum("weight").alias("weight"))


@query("metrics_block_ci", with_views(
    f"""SELECT * FROM ({S.metrics(['n', 'brier', 'log_loss', 'accuracy', 'ece', 'mce',
                                   'reliability', 'resolution'])}) m
        JOIN ({_INTERVALS}) i USING (variant)""", "preds",
    stats=S.stats("preds"), scored=SCORED,
    sums=S.replicate_sums("scored", "variant, bin, ", ["p", "y", "sq"], REPS)))
def metrics_block_ci(t: Tables):
    intervals = R.bootstrap_ci(t.preds)
    block = calibration.metrics_block(t.preds, intervals=intervals)
    return rounded(block.select(
        "variant", "n", "brier", "log_loss", "accuracy", "ece", "mce", "murphy.reliability",
        "murphy.resolution", "brier_lo", "brier_hi", "ece_lo", "ece_hi"))


def _share_sql(by: str) -> str:
    return with_views(
        f"""SELECT m.*, s.lo, s.hi FROM (
            SELECT {by}, {S.interval('x / weight', '')} FROM sums GROUP BY {by}) s
            JOIN (SELECT {by}, 'truncated' AS category, count(*) AS n,
              round(avg(x) + 1e-12, 9) AS rate FROM flags GROUP BY {by}) m USING ({by})""", "preds",
        flags=f"SELECT {by}, row_id, CAST(CAST(coalesce(truncated, FALSE) AS INT) AS DOUBLE) AS x FROM preds",
        sums=S.replicate_sums("flags", f"{by}, ", ["x"], REPS))


@query("proportion_ci", _share_sql("variant"))
def proportion_ci(t: Tables):
    return rounded(R.proportion_ci(t.preds, ["variant"], {"truncated": F.col("truncated")}))


@query("proportion_ci_cells", _share_sql("season"))
def proportion_ci_cells(t: Tables):
    """Groups in which an id comes several times."""
    return rounded(R.proportion_ci(t.preds, ["season"], {"truncated": F.col("truncated")}))


_DIFFS = ["(a - outcome) ** 2 - (b - outcome) ** 2",
          "(a - outcome) ** 2 - (market - outcome) ** 2",
          "(b - outcome) ** 2 - (market - outcome) ** 2",
          "CAST((a > 0.5) = (outcome = 1) AS INT) - CAST((b > 0.5) = (outcome = 1) AS INT)",
          "CAST((a > 0.5) = (outcome = 1) AS INT) - CAST((market > 0.5) = (outcome = 1) AS INT)",
          "CAST((b > 0.5) = (outcome = 1) AS INT) - CAST((market > 0.5) = (outcome = 1) AS INT)"]
_NAMES = [(m, p) for m in ("brier", "accuracy") for p in ("a - b", "a - market", "b - market")]
_COLS = [f"d{i}" for i in range(6)]


def _paired_sql(paired: str) -> str:
    return with_views(
        " UNION ALL ".join(
            f"""SELECT '{metric}' AS metric, '{pair}' AS pair, m.n, round(m.mean + 1e-12, 9) AS mean,
            s.lo, s.hi, s.lo > 0 OR s.hi < 0 AS significant
            FROM (SELECT {S.interval(f'{d} / weight', '')} FROM sums) s
            CROSS JOIN (SELECT count(*) AS n, avg({d}) AS mean FROM diffs) m"""
            for d, (metric, pair) in zip(_COLS, _NAMES)),
        "preds", paired=paired,
        diffs="SELECT row_id, " + ", ".join(
            f"CAST({sql} AS DOUBLE) AS {d}" for d, sql in zip(_COLS, _DIFFS)) + " FROM paired",
        sums=S.replicate_sums("diffs", "", _COLS, PAIRED_REPS))


@query("paired_bootstrap", _paired_sql(PAIRED))
def paired_bootstrap(t: Tables):
    paired = pairing.paired_join(t.preds, "direct", "masked")
    return rounded(R.paired_bootstrap(paired))


@query("paired_bootstrap_cells", _paired_sql(
    PAIRED.replace("'direct'", "'zeroshot'").replace("'masked'", "'direct'")))
def paired_bootstrap_cells(t: Tables):
    """Another pair of forecasters."""
    return rounded(R.paired_bootstrap(pairing.paired_join(t.preds, "zeroshot", "direct")))
