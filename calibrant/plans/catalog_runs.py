"""Runs over time: stored answers, telemetry, trajectories, ceilings and the stream monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.functions.wording import possession_line, render_prompt
from calibrant.operators import boosting, ceiling, requests, telemetry, trajectory
from calibrant.operators.calibration import score
from calibrant.operators.rates import backoff_lookup
from calibrant.operators.staging import computed_once
from calibrant.plans import sqltext as S
from calibrant.plans.catalog_data import coarse_keys, fitted
from calibrant.plans.catalog_text import RESPONSES, REWARDED, responses, rewarded
from calibrant.plans.fixtures import Tables, with_views
from calibrant.plans.registry import CHECKS, query, rounded
from calibrant.session import run_folder
from calibrant.sources import logs
from calibrant.sources.answers import AnswerStore
from calibrant.functions.scoring import score_reward
from calibrant.streaming import drain, monitor

REQUESTS = f"""SELECT row_id, sha1(to_json({{'m': model, 'p': prompt, 'max_tokens': 900,
    'sys': 'be brief', 'temperature': 0.7::DOUBLE, 'top_p': 0.95::DOUBLE}})) AS key FROM (SELECT row_id, {S.PROMPT} AS prompt,
    CASE WHEN row_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS model FROM plays) x"""


def _requests(t: Tables) -> DataFrame:
    model = F.when(F.col("row_id") % 2 == 0, "base").otherwise("tuned")
    prompts = computed_once(t.plays, prompt=render_prompt())
    return requests.with_request_key(
        prompts, model, F.col("prompt"), max_tokens=F.lit(900), temperature=F.lit(0.7),
        top_p=F.lit(0.95), sys=F.lit("be brief")
    ).select("row_id", "key")


def _answers(rows: DataFrame) -> DataFrame:
    text = F.concat(F.lit("answer "), F.col("row_id").cast("string"))
    return rows.select("key", "row_id", text.alias("text"))


@query("response_store", with_views(
    """SELECT key, row_id, concat('answer ', row_id) AS text FROM (
         SELECT key, coalesce(min(row_id) FILTER (WHERE row_id % 3 = 0), min(row_id)) AS row_id
         FROM requests WHERE row_id % 3 <> 1 GROUP BY key) r""", "plays", requests=REQUESTS))
def response_store(t: Tables):
    rows = _requests(t)
    empty = _answers(rows.limit(0))
    stored = requests.merge_store(empty, _answers(rows.where(F.col("row_id") % 3 == 0)), "row_id")
    fresh = _answers(rows.where(F.col("row_id") % 3 == 2))
    return requests.merge_store(stored, fresh, "row_id")


def _store(t: Tables) -> AnswerStore:
    return AnswerStore(t.spark, run_folder(t.spark, "answers"), buckets=64)


@query("indexed_store", CHECKS["response_store"])
def indexed_store(t: Tables):
    """The store in buckets with filters; the second batch reads the buckets it may be in."""
    rows, store = _requests(t), _store(t)
    store.add(_answers(rows.where(F.col("row_id") % 3 == 0)), "row_id")
    store.add(_answers(rows.where(F.col("row_id") % 3 == 2)), "row_id")
    return store.read()


@query("indexed_pending", with_views(
    """SELECT DISTINCT key FROM requests WHERE key NOT IN
       (SELECT key FROM requests WHERE row_id % 3 = 0)""", "plays", requests=REQUESTS))
def indexed_pending(t: Tables):
    rows, store = _requests(t), _store(t)
    store.add(_answers(rows.where(F.col("row_id") % 3 == 0)), "row_id")
    return store.pending(rows).select("key")


@query("pending_requests", with_views(
    """SELECT DISTINCT key FROM requests WHERE key NOT IN
       (SELECT key FROM requests WHERE row_id % 3 = 0)""", "plays", requests=REQUESTS))
def pending_requests(t: Tables):
    rows = _requests(t)
    return requests.pending_requests(rows, rows.where(F.col("row_id") % 3 == 0)).select("key")


@query("reward_telemetry", with_views(
    f"""SELECT step, round(avg(CAST(format_ok AS INT)) + 1e-12, 9) AS format_success_rate,
        round(avg(length(text)) + 1e-12, 9) AS mean_completion_chars,
        round(avg(1 - brier) + 1e-12, 9) AS mean_brier_reward,
        round(avg(reward) FILTER (WHERE format_ok) + 1e-12, 9) AS mean_reward,
        round(avg(prob) + 1e-12, 9) AS mean_predicted_prob,
        round(avg(abs(prob - 0.5)) + 1e-12, 9) AS mean_confidence,
        round(stddev_pop(prob) + 1e-12, 9) AS pred_prob_std, max(batch_ece) AS batch_ece
        FROM (SELECT *, CAST(row_id // 32 AS BIGINT) AS step FROM rewarded) r
        LEFT JOIN (SELECT step, CASE WHEN sum(n) >= 20
          THEN round(sum(n * abs(sp / n - sy / n)) / sum(n) + 1e-12, 9) END AS batch_ece
          FROM ({S.stats("(SELECT *, CAST(row_id // 32 AS BIGINT) AS step FROM rewarded)", "step")}) s
          GROUP BY step) e USING (step) GROUP BY step""", "completions", rewarded=REWARDED))
def reward_telemetry(t: Tables):
    scored = rewarded(t).select(
        F.floor(F.col("row_id") / 32).alias("step"), F.col("r").alias("reward"), "outcome",
        F.length("text").alias("chars"))
    return rounded(telemetry.reward_telemetry(scored))


_STEPPED = "(SELECT *, CAST(row_id // 16 AS BIGINT) AS step FROM preds)"


@query("checkpoint_eval", with_views(
    f"""SELECT m.*, c.format_success, c.market_brier FROM
        ({S.metrics(['n', 'brier', 'ece', 'reliability', 'resolution', 'uncertainty', 'brier_check'],
                    by='variant, step')}) m
        JOIN (SELECT variant, step, round(avg(CAST(prob IS NOT NULL AS INT)) + 1e-12, 9) AS format_success,
          round(avg((market - outcome) ** 2) FILTER (WHERE prob IS NOT NULL) + 1e-12, 9) AS market_brier,
          FROM {_STEPPED} x GROUP BY variant, step) c
        ON m.step = c.step AND m.variant = c.variant WHERE m.n >= 10""",
    "preds", stats=S.stats(_STEPPED, "variant, step")))
def checkpoint_eval(t: Tables):
    stepped = t.preds.withColumn("step", F.floor(F.col("row_id") / 16))
    return rounded(telemetry.checkpoint_eval(stepped, ["variant", "step"]).drop(
        "mean_predicted_prob"))


@query("format_probe", with_views(
    """SELECT outcome, count(*) AS samples, round(count(prob) / count(*) + 1e-12, 9) AS format_success,
       round(avg(CAST(truncated AS INT)) + 1e-12, 9) AS truncated,
       round(avg(CAST(reasoning <> '' OR contains(lower(text), '<think>') AS INT)) + 1e-12, 9)
       AS think_present, round(avg(prob) + 1e-12, 9) AS mean_prob, round(stddev_pop(prob) + 1e-12, 9) AS std_prob,
       min(prob) AS min_prob, max(prob) AS max_prob,
       round(avg(abs(prob - 0.5)) + 1e-12, 9) AS mean_confidence,
       round(avg(CAST(prob > 0.9 OR prob < 0.1 AS INT)) FILTER (WHERE prob IS NOT NULL) + 1e-12, 9)
       AS extreme_share,
       CAST(floor(median(length(text) + length(reasoning))) AS INT) AS median_chars,
       CAST(max(length(text) + length(reasoning)) AS INT) AS max_chars
       FROM responses GROUP BY outcome""", "completions", responses=RESPONSES))
def format_probe(t: Tables):
    return rounded(telemetry.format_probe(responses(t), ["outcome"]))


RUNS = "(SELECT *, variant AS run, season - 1995 AS step FROM preds WHERE variant <> 'masked' OR season > 1995)"


@query("trajectory_series", with_views(
    """SELECT run, step, 'brier' AS metric, brier AS value FROM m UNION ALL
       SELECT run, step, 'ece', ece FROM m UNION ALL
       SELECT 'masked', 0, 'brier', 0.2525 UNION ALL SELECT 'masked', 0, 'ece', 0.1917""",
    "preds", stats=S.stats(RUNS, "run, step"),
    m=S.metrics(["brier", "ece"], by="run, step")))
def trajectory_series(t: Tables):
    runs = t.preds.where((F.col("variant") != "masked") | (F.col("season") > 1995)).withColumns(
        {"run": F.col("variant"), "step": F.col("season") - 1995})
    points = trajectory.to_long(score(runs, ["brier", "ece"], ["run", "step"]), ["brier", "ece"])
    return rounded(trajectory.trajectory_series(points, {"brier": 0.2525, "ece": 0.1917}))


@query("log_scan", with_views(
    """SELECT variant AS run, season AS step, 'brier' AS metric,
       round(avg((prob - outcome) ** 2), 4) AS value FROM preds GROUP BY variant, season
       UNION ALL SELECT variant, season, 'mean_predicted_prob', round(avg(prob), 4)
       FROM preds GROUP BY variant, season
       UNION ALL SELECT DISTINCT variant, season, 'note', CAST(NULL AS DOUBLE) FROM preds""", "preds"))
def log_scan(t: Tables):
    """Logs written from the predictions, one folder per run, then scanned."""
    figures = t.preds.groupBy("variant", "season").agg(
        F.round(F.avg((F.col("prob") - F.col("outcome")) ** 2), 4).alias("brier"),
        F.round(F.avg("prob"), 4).alias("mean"))
    line = F.format_string(
        "INFO [eval @ %s] {'eval/brier': 9.0} retry [eval @ %s]  {'eval/brier': %s, "
        "'eval/mean_predicted_prob': %s, 'eval/note': 'as before', } [eval @ %s] {broken}",
        F.col("season"), F.col("season"), F.col("brier").cast("string"),
        F.col("mean").cast("string"), F.col("season"))
    path = run_folder(t.spark, "logs")
    figures.select(F.col("variant").alias("run"), line.alias("value")).write.partitionBy(
        "run").text(path)
    return logs.log_scan(t.spark, path)


@query("ceiling_table", with_views(
    S.metrics(["n", "brier", "ece"], by="split, variant"), "labelled", keyed=S.keyed(),
    **S.rate_levels("c", S.COARSE),
    coarse=S.looked_up("c", S.COARSE, "(SELECT * FROM keyed WHERE split <> 'train')",
                       "r.row_id, r.split, r.outcome, r.vegas_wp, r.wp", "target", 5),
    forecasts="""SELECT split, 'rate' AS variant, target AS prob, outcome FROM coarse UNION ALL
      SELECT split, 'external', wp, outcome FROM coarse UNION ALL
      SELECT split, 'market', vegas_wp, outcome FROM coarse""",
    stats=S.stats("forecasts", "split, variant",
                  bin_sql="least(CAST(floor(prob * 10) AS INT), 9)")))
def ceiling_table(t: Tables):
    """Both held-out splits."""
    keys = coarse_keys()
    held_out = t.labelled.where(F.col("split") != "train")
    rows = backoff_lookup(held_out, fitted(t, keys), keys, "target", 5)
    return rounded(ceiling.ceiling_table(rows, {
        "rate": F.col("target"), "external": F.col("wp"), "market": F.col("vegas_wp"),
    }, rule="floor"))


@query("ceiling_boosted", with_views(
    """SELECT split, v.variant, count(*) AS n, TRUE AS in_bounds FROM labelled
       CROSS JOIN (VALUES ('boosted'), ('market')) v(variant) WHERE split <> 'train'
       GROUP BY split, v.variant""", "labelled"))
def ceiling_boosted(t: Tables):
    """Boosted trees on the state features, trained on the training seasons, on both held-out splits.

    What the trees forecast cannot be said in SQL; checked are the rows scored and that every score
    lies in the bounds it must.
    """
    rows = t.labelled.withColumn("spread_line", possession_line(
        F.col("spread_line"), F.col("posteam"), F.col("home_team")))
    kept = rows.select("outcome", "vegas_wp", "split", *ceiling.FEATURE_COLUMNS)
    scored = ceiling.boosted_forecast(
        kept.where(F.col("split") == "train"), kept.where(F.col("split") != "train"))
    table = ceiling.ceiling_table(scored, {
        "boosted": F.col("boosted"), "market": F.col("vegas_wp")})
    bounds = F.col("brier").between(0, 0.5) & F.col("ece").between(0, 1)
    return table.select("split", "variant", "n", bounds.alias("in_bounds"))


#: Cut values of the stumps; a value lies in the range of the cuts below it.
STUMP_CUTS = {
    "score_differential": S.SCORE_EDGES, "game_seconds_remaining": S.TIME_EDGES,
    "spread_line": S.SPREAD_EDGES, "down": (1, 2, 3), "yardline_100": S.FIELD_EDGES, "qtr": (1, 2, 3, 4),
}
STUMPS = boosting.Boosting(rounds=4, depth=1, rate=0.3)


def _stump_views() -> dict[str, str]:
    """Four rounds of trees with one split, written out over rows."""
    n, one, l2 = len(STUMP_CUTS), boosting.ONE, STUMPS.l2
    value = {f: S.POSSESSION_LINE if f == "spread_line" else f for f in STUMP_CUTS}
    ranges = ", ".join(
        f"CASE WHEN {value[f]} IS NULL THEN -1 ELSE " + " + ".join(f"CAST({value[f]} > {e} AS INT)" for e in edges)
        + f" END AS b{i}" for i, (f, edges) in enumerate(STUMP_CUTS.items()))
    views = {"s0": f"""SELECT row_id, split, outcome AS y, vegas_wp, {ranges},
      (SELECT ln(avg(outcome) / (1 - avg(outcome))) FROM labelled WHERE split = 'train') AS score FROM labelled"""}
    cuts = " UNION ALL ".join(
        f"SELECT {i} AS f, c, c = {len(edges)} AS beyond FROM generate_series(0, {len(edges)}) x(c)"
        for i, edges in enumerate(STUMP_CUTS.values()))
    stacked = " UNION ALL ".join(f"SELECT {i} AS f, b{i} AS b, g, h FROM e" for i in range(n))
    asked = "CASE f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(n)) + " END"

    def worth(g, h):
        return f"({g} / {one}e0) * ({g} / {one}e0) / ({h} / {one}e0 + {l2})"

    for r in range(STUMPS.rounds):
        views[f"h{r}"] = f"""SELECT f, b, sum(g) AS g, sum(h) AS h, count(*) AS n FROM (
            WITH e AS (SELECT *, CAST(round_even(p * {one}, 0) AS BIGINT) - y * {one} AS g,
              CAST(round_even(p * (1 - p) * {one}, 0) AS BIGINT) AS h
              FROM (SELECT *, 1 / (1 + exp(-score)) AS p FROM s{r} WHERE split = 'train') x)
            {stacked}) u GROUP BY f, b"""
        views[f"c{r}"] = f"""SELECT f, c, coalesce(side, n1 >= n2) AS missing_left,
            -{STUMPS.rate} * (g1 / {one}e0) / (h1 / {one}e0 + {l2}) AS left_leaf,
            -{STUMPS.rate} * (g2 / {one}e0) / (h2 / {one}e0 + {l2}) AS right_leaf
          FROM (SELECT k.f, k.c, side, sum(g) FILTER (WHERE toleft) AS g1, sum(h) FILTER (WHERE toleft) AS h1,
              coalesce(sum(n) FILTER (WHERE toleft), 0) AS n1,
              sum(g) FILTER (WHERE NOT toleft) AS g2, sum(h) FILTER (WHERE NOT toleft) AS h2,
              coalesce(sum(n) FILTER (WHERE NOT toleft), 0) AS n2, sum(g) AS g, sum(h) AS h
            FROM (SELECT h.*, k.c, side, CASE WHEN h.b < 0 THEN side ELSE h.b <= k.c END AS toleft
              FROM h{r} h JOIN ({cuts}) k ON h.f = k.f
              JOIN (SELECT f, min(b) < 0 AS gone FROM h{r} GROUP BY f) m ON m.f = h.f AND (gone OR NOT beyond)
              JOIN (VALUES (TRUE), (FALSE), (NULL)) v(side) ON (side IS NOT NULL) = gone) k
            GROUP BY k.f, k.c, side) q
          WHERE least(n1, n2) >= {STUMPS.least_rows}
          ORDER BY {worth('g1', 'h1')} + {worth('g2', 'h2')} - {worth('g', 'h')} DESC, f, side DESC, c LIMIT 1"""
        views[f"s{r + 1}"] = f"""SELECT s.* EXCLUDE (score), score + CASE
            WHEN CASE WHEN {asked} < 0 THEN missing_left ELSE {asked} <= c END THEN left_leaf ELSE right_leaf END
            AS score FROM s{r} s CROSS JOIN c{r}"""
    return views


@query("ceiling_stumps", with_views(
    S.metrics(["n", "brier", "ece"], by="split, variant"), "labelled", **_stump_views(),
    forecasts=f"""SELECT split, 'boosted' AS variant, 1 / (1 + exp(-score)) AS prob, y AS outcome
      FROM s{STUMPS.rounds} WHERE split <> 'train' UNION ALL
      SELECT split, 'market', vegas_wp, y FROM s0 WHERE split <> 'train'""",
    stats=S.stats("forecasts", "split, variant")))
def ceiling_stumps(t: Tables):
    """A few boosted trees of one split, with the scores that the checking SQL reaches row by row."""
    rows = t.labelled.withColumn("spread_line", possession_line(
        F.col("spread_line"), F.col("posteam"), F.col("home_team")))
    kept = rows.select("outcome", "vegas_wp", "split", *STUMP_CUTS)
    scored = ceiling.boosted_forecast(
        kept.where(F.col("split") == "train"), kept.where(F.col("split") != "train"), list(STUMP_CUTS),
        settings=STUMPS, cuts=STUMP_CUTS)
    return rounded(ceiling.ceiling_table(scored, {"boosted": F.col("boosted"), "market": F.col("vegas_wp")}))


_EVENTS = """SELECT ts, event_type AS variant,
  CAST(CAST(floor(value) AS BIGINT) % 101 AS DOUBLE) / 100 AS prob,
  CAST(json_extract_string(props, '$.k') AS INT) % 2 AS outcome,
  time_bucket(INTERVAL 1 DAY, ts) AS day FROM events"""


@query("stream_calibration", with_views(
    f"""SELECT strftime(day, '%Y-%m-%d') AS day, * EXCLUDE (day) FROM (
        {S.metrics(['n', 'brier', 'log_loss', 'accuracy', 'ece', 'mce'], by='day, variant')}) m
        """,
    events_scored=_EVENTS, stats=S.stats("events_scored", "day, variant")))
def stream_calibration(t: Tables):
    """The event stream through the daily monitor, then its table finished to scores."""
    schema = t.read("events").schema
    stream = t.spark.readStream.schema(schema).option(
        "pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    scored = stream.select(
        # Event times are stored without a zone; as UTC instants their days are the stored days.
        F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp").alias("ts"),
        F.col("event_type").alias("variant"),
        ((F.floor("value") % 101).cast("double") / 100).alias("prob"),
        (F.get_json_object("props", "$.k").cast("int") % 2).alias("outcome"))
    folder = run_folder(t.spark, "monitor")
    running = monitor.start_monitor(
        monitor.stream_stats(scored), f"{folder}/table", f"{folder}/checkpoint")
    running.awaitTermination()
    emitted = monitor.latest_stats(t.spark, f"{folder}/table")
    scores = monitor.monitor_metrics(
        emitted, metrics=["n", "brier", "log_loss", "accuracy", "ece", "mce"])
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window_start") / 86400).cast("int"))
    return rounded(scores.select(
        day.cast("string").alias("day"), "variant", "n", "brier",
        "log_loss", "accuracy", "ece", "mce"))


_ANSWERED = """SELECT *, CASE WHEN prob IS NOT NULL THEN least(greatest(prob, 0.01e0), 0.99e0) END AS p
  FROM (SELECT CAST(floor(date_part('epoch', ts)) AS BIGINT) // 86400 AS step, length(props) AS chars,
    CASE WHEN event_id % 11 <> 0 THEN CAST(CAST(floor(value) AS BIGINT) % 101 AS DOUBLE) / 100 END AS prob,
    CAST(json_extract_string(props, '$.k') AS INT) % 2 AS outcome FROM events) e"""


@query("stream_reward_telemetry", with_views(
    f"""SELECT step, count(*) AS answers, round(avg(CAST(prob IS NOT NULL AS INT)) + 1e-12, 9) AS format_success_rate,
        round(avg(chars) + 1e-12, 9) AS mean_completion_chars,
        round(avg(1 - (p - outcome) ** 2) + 1e-12, 9) AS mean_brier_reward,
        round(avg(1 - (p - outcome) ** 2) + 1e-12, 9) AS mean_reward,
        round(avg(p) + 1e-12, 9) AS mean_predicted_prob, round(avg(abs(p - 0.5e0)) + 1e-12, 9) AS mean_confidence,
        round(stddev_pop(p) + 1e-12, 9) AS pred_prob_std, max(batch_ece) AS batch_ece FROM answered
        LEFT JOIN (SELECT step, CASE WHEN sum(n) >= 20
          THEN round(sum(abs(gap)) / sum(n) + 1e-12, 9) END AS batch_ece
          FROM (SELECT step, {S.grid_bin('p')} AS bin, sum(p - outcome) AS gap, count(p) AS n
            FROM answered WHERE p IS NOT NULL GROUP BY ALL) b GROUP BY step) e USING (step)
        GROUP BY step""", answered=_ANSWERED))
def stream_reward_telemetry(t: Tables):
    """Events as scored answers, drained step by step from a stream."""
    schema = t.read("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    ts = F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp")
    prob = F.when(F.col("event_id") % 11 != 0, (F.floor("value") % 101).cast("double") / 100)
    outcome = F.get_json_object("props", "$.k").cast("int") % 2
    scored = stream.select(
        ts.alias("ts"), F.floor(F.unix_seconds(ts) / 86400).alias("step"), score_reward(prob, outcome).alias("reward"),
        outcome.alias("outcome"), F.length("props").alias("chars"))
    folder = run_folder(t.spark, "drain")
    drain.start_drain(drain.drained_telemetry(scored), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return rounded(drain.latest_figures(t.spark, f"{folder}/table").drop("closed"))
