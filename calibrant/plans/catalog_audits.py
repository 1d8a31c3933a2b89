"""Audit requests, verdicts, agreement and inspection views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.functions import audit
from calibrant.functions.extract import answer_region
from calibrant.operators import judging
from calibrant.operators.staging import with_probability, with_verdict
from calibrant.plans import sqltext as S
from calibrant.plans.catalog_text import TRUTH, truths
from calibrant.plans.fixtures import AUDITED, Tables, with_views
from calibrant.plans.registry import CHECKS, query, rounded
from calibrant.schemas import BOOLEAN_CATEGORIES
from calibrant.session import run_folder
from calibrant.sources import judged as judged_source


def judged(t: Tables) -> DataFrame:
    return with_verdict(t.audits)


_FLAGS = ", ".join(
    f"CASE WHEN ok AND json_type(cut, '$.{c}.v') = 'BOOLEAN'"
    f" THEN json_extract_string(cut, '$.{c}.v') = 'true' END AS {c}" for c in BOOLEAN_CATEGORIES)
JUDGED = f"""SELECT row_id, game_id, label, mode, parsed_prob, ok, ok AND cut <> '{{}}' AS usable,
  {_FLAGS}, CASE WHEN ok THEN json_extract_string(cut, '$.faithfulness.v') END AS faithfulness,
  CASE WHEN ok THEN json_extract_string(cut, '$.faithfulness.q') END AS why FROM (
  SELECT *, coalesce(json_valid(cut), FALSE) AS ok FROM (
    SELECT *, {S.json_cut('reply')} AS cut FROM audits) x) y"""
_FALSE_IF_NULL = ", ".join(f"coalesce({c}, FALSE) AS {c}" for c in BOOLEAN_CATEGORIES)


@query("parse_verdict", with_views(
    f"""SELECT row_id, label, ok AS parse_ok, usable, {', '.join(BOOLEAN_CATEGORIES)}, faithfulness,
        why FROM judged""", "audits", judged=JUDGED))
def parse_verdict(t: Tables):
    v = F.col("verdict")
    return judged(t).select(
        "row_id", "label", v["parse_ok"].alias("parse_ok"), v["usable"].alias("usable"),
        *[v[c]["v"].alias(c) for c in BOOLEAN_CATEGORIES],
        v["faithfulness"]["v"].alias("faithfulness"), v["faithfulness"]["q"].alias("why"))


@query("judge_failures", with_views(
    "SELECT label, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS failed FROM judged GROUP BY label",
    "audits", judged=JUDGED))
def judge_failures(t: Tables):
    return judging.judge_failures(judged(t))


_FOUND = [*[(c, c) for c in BOOLEAN_CATEGORIES],
          ("faithfulness(inconsistent)", "coalesce(faithfulness = 'inconsistent', FALSE)")]
_FLAGS = [f"f{i}" for i in range(len(_FOUND))]


def _rates_sql(source: str, flags: list[str], names: list[str | None]) -> dict[str, str]:
    """Rate and interval of every flag of ``source`` per label."""
    lines = " UNION ALL ".join(
        f"""SELECT m.label, {"" if name is None else f"'{name}' AS category, "}m.n,
        round(m.rate + 1e-12, 9) AS rate, s.lo, s.hi
        FROM (SELECT label, {S.interval(f'{flag} / weight', '')} FROM sums GROUP BY label) s
        JOIN (SELECT label, count(*) AS n, avg({flag}) AS rate FROM flags GROUP BY label) m
        ON s.label = m.label""" for flag, name in zip(flags, names))
    return with_views(lines, "audits", judged=JUDGED, flags=source,
                      sums=S.replicate_sums("flags", "label, ", flags, 2000))


VERDICT_RATES = _rates_sql(
    "SELECT label, row_id, " + ", ".join(
        f"CAST(CAST(coalesce({sql}, FALSE) AS INT) AS DOUBLE) AS {flag}"
        for flag, (_, sql) in zip(_FLAGS, _FOUND)) + " FROM judged WHERE usable",
    _FLAGS, [name for name, _ in _FOUND])
FAITHFULNESS_RATES = _rates_sql(
    """SELECT label, row_id, CAST(CAST(faithfulness = 'inconsistent' AS INT) AS DOUBLE) AS f0
       FROM judged WHERE faithfulness IN ('consistent', 'inconsistent', 'unclear')""", ["f0"], [None])


@query("verdict_rates", VERDICT_RATES)
def verdict_rates(t: Tables):
    return rounded(judging.verdict_rates(judged(t)))


@query("faithfulness_rates", FAITHFULNESS_RATES)
def faithfulness_rates(t: Tables):
    return rounded(judging.faithfulness_rates(judged(t)))


HAND = "SELECT game_id, label, " + ", ".join(
    f"arg_max({c}, label_no) AS {c}" for c in BOOLEAN_CATEGORIES) + \
    ", max(label_no) AS label_no FROM hand_labels GROUP BY game_id, label"


@query("human_label_join", with_views(
    "SELECT j.game_id, j.label, j.row_id, h.label_no, " + ", ".join(
        f"coalesce(j.{c}, FALSE) AS judge_{c}, h.{c} AS human_{c}" for c in BOOLEAN_CATEGORIES)
    + """ FROM judged j JOIN hand h ON j.game_id = h.game_id AND j.label = h.label
          WHERE j.usable""", "audits", "hand_labels", judged=JUDGED, hand=HAND))
def human_label_join(t: Tables):
    return judging.human_label_join(judged(t), t.hand_labels)


_PAIRS = " UNION ALL ".join(
    f"SELECT '{c}' AS category, CAST(h.{c} AS INT) AS a, CAST(coalesce(j.{c}, FALSE) AS INT) AS b"
    " FROM judged j JOIN hand h ON j.game_id = h.game_id AND j.label = h.label WHERE j.usable"
    for c in BOOLEAN_CATEGORIES)
_KAPPA = """SELECT {by} n, round(po + 1e-12, 9) AS agree,
  round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1 END + 1e-12, 9) AS kappa FROM (
  SELECT {by} count(*) AS n, avg(CAST(a = b AS INT)) AS po,
    avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM pairs {group}) k"""


@query("agreement", with_views(
    _KAPPA.format(by="category,", group="GROUP BY category"), "audits", "hand_labels",
    judged=JUDGED, hand=HAND, pairs=_PAIRS))
def agreement(t: Tables):
    pairs = judging.rater_pairs(judged(t), t.hand_labels)
    return rounded(judging.agreement(pairs, ["category"]))


@query("agreement_labels", "WITH pairs AS (SELECT quality AS a, toxic AS b FROM labels) "
       + _KAPPA.format(by="", group=""))
def agreement_labels(t: Tables):
    return rounded(judging.agreement(judging.count_pairs(t.read("labels"), "quality", "toxic")))


@query("category_union", """SELECT coalesce(a.v, b.v) AS value, CAST(coalesce(a.n, 0) AS BIGINT) AS n_a,
    CAST(coalesce(b.n, 0) AS BIGINT) AS n_b, CAST(coalesce(c.n, 0) AS BIGINT) AS n_both
  FROM (SELECT quality AS v, count(*) AS n FROM labels GROUP BY quality) a
  FULL JOIN (SELECT toxic AS v, count(*) AS n FROM labels GROUP BY toxic) b ON a.v = b.v
  LEFT JOIN (SELECT quality AS v, count(*) AS n FROM labels WHERE quality = toxic GROUP BY quality) c
  ON c.v = coalesce(a.v, b.v)""")
def category_union(t: Tables):
    return judging.category_marginals(judging.count_pairs(t.read("labels"), "quality", "toxic"))


_MODES = [(label, mode) for label, mode, _ in AUDITED]


@query("fan_out_variants", with_views(
    "SELECT row_id, game_id, m.label, m.mode FROM labelled CROSS JOIN (VALUES "
    + ", ".join(f"('{label}', '{mode}')" for label, mode in _MODES) + ") m(label, mode)", "labelled"))
def fan_out_variants(t: Tables):
    return judging.fan_out_variants(t.labelled.select("row_id", "game_id"), _MODES)


_QUOTED = audit.VERDICT_INSTRUCTION.replace("'", "''")


@query("judge_request", with_views(
    f"""SELECT row_id, concat('TRUE game state (ground truth):', chr(10), '- Possession: ', posteam,
        ' has the ball; opponent is ', defteam, chr(10), '- Score: ', score, chr(10), '- Period: ',
        period, ', ', coalesce(clock, 'None'), ' left', chr(10), '- Down & distance: ',
        CASE WHEN down IS NULL THEN 'n/a' ELSE concat(down, ' and ', ydstogo) END, chr(10),
        '- Field position: ', field_position, chr(10), '- Pregame line: ',
        CASE WHEN side IN ('favored', 'underdog')
          THEN concat(posteam, ' ', side, ' by ', CAST(points AS VARCHAR))
          WHEN side = 'pickem' THEN 'pick''em' ELSE 'unknown' END, chr(10), chr(10),
        'FORECASTER REASONING:', chr(10), '\"\"\"', chr(10), trim(text), chr(10), '\"\"\"', chr(10),
        chr(10), 'The forecaster''s final stated probability that ', posteam, ' wins: ',
        coalesce(CAST(prob AS VARCHAR), 'None'), chr(10), chr(10), '{_QUOTED}') AS request
        FROM truth JOIN (SELECT row_id, text, prob FROM
          ({S.extracted('completions', 'text', 'row_id, text')}) e) c USING (row_id)""",
    "labelled", "completions", truth=TRUTH))
def judge_request(t: Tables):
    answers = with_probability(t.completions.select("row_id", "text"))
    rows = truths(t).join(answers, "row_id")
    return rows.select("row_id", audit.judge_request(
        F.col("truth"), F.col("text"), F.col("prob")).alias("request"))


_SYSTEM = audit.SYSTEM_MESSAGE.replace("'", "''")


@query("judge_messages_text", f"""WITH r AS ({CHECKS['judge_request']})
    SELECT row_id, 'system' AS role, '{_SYSTEM}' AS content FROM r
    UNION ALL SELECT row_id, 'user', request FROM r""")
def judge_messages_text(t: Tables):
    """Both messages of every request, with the completions and their probabilities."""
    answers = with_probability(t.completions.select("row_id", "text"))
    rows = truths(t).join(answers, "row_id")
    return rows.select("row_id", F.inline(audit.judge_messages(
        F.col("truth"), F.col("text"), F.col("prob"))))


@query("flip_examples", with_views(
    """SELECT a.row_id, t.period, t.score, a.parsed_prob AS a_prob, a.why AS a_why,
       b.parsed_prob AS b_prob, b.why AS b_why FROM judged a JOIN judged b ON a.row_id = b.row_id
       JOIN truth t ON a.row_id = t.row_id WHERE a.label = 'base' AND b.label = 'masked'
       AND a.faithfulness = 'inconsistent' AND b.faithfulness = 'consistent'""",
    "audits", judged=JUDGED, truth=TRUTH))
def flip_examples(t: Tables):
    return _flips(t).select(
        "row_id", "truth.period", "truth.score", "a_prob", "a_why", "b_prob", "b_why")


def _flips(t: Tables):
    rows = judged(t).join(truths(t).withColumnRenamed("truth", "ground_truth"), "row_id")
    return judging.flip_examples(rows, "base", "masked")


def _text_of(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), 'None')"


@query("flip_report", with_views(
    f"""SELECT a.row_id, count(*) OVER () AS flips, concat(t.game_id, ' | ', period, ' ',
        {_text_of('clock')}, ' | ', posteam, ' ', score, ' | down ', {_text_of('down')}, '&', ydstogo,
        ' | ', field_position, ' | spread ', posteam, ' ', {_text_of('points')}, ' | phat=', printf('%.2f', target_prob),
        ' outcome=', actual_outcome) AS state,
        concat('p=', {_text_of('a.parsed_prob')}, ': ', coalesce(a.why, 'None')) AS first,
        concat('p=', {_text_of('b.parsed_prob')}, ': ', coalesce(b.why, 'None')) AS second
        FROM judged a JOIN judged b ON a.row_id = b.row_id JOIN truth t ON a.row_id = t.row_id
        WHERE a.label = 'base' AND b.label = 'masked'
        AND a.faithfulness = 'inconsistent' AND b.faithfulness = 'consistent'
        ORDER BY a.row_id LIMIT 12""",
    "audits", judged=JUDGED, truth=TRUTH))
def flip_report(t: Tables):
    return judging.flip_report(_flips(t))


@query("side_by_side", with_views(
    f"""SELECT row_id, outcome, 0.5 * market + 0.25 AS target, market, base.prob AS base_prob,
        base.answer_tail AS base_tail, direct.prob AS direct_prob,
        direct.answer_tail AS direct_tail FROM
        (SELECT row_id, outcome, market, {{'prob': prob,
           'answer_tail': replace(right(region, 220), chr(10), ' ')}} AS base FROM (
           SELECT *, {S.region('text')} AS region FROM
           ({S.extracted('completions', 'text', '*')}) e) r) b
        LEFT JOIN (SELECT row_id, {{'prob': prob,
           'answer_tail': concat('It is ', CAST(prob AS VARCHAR))}} AS direct
           FROM preds WHERE variant = 'direct' AND prob IS NOT NULL) d USING (row_id)""",
    "completions", "preds"))
def side_by_side(t: Tables):
    target = (0.5 * F.col("market") + 0.25).alias("target")
    base = with_probability(t.completions).select(
        "row_id", F.lit("base").alias("variant"), "text", "prob", "outcome", target, "market")
    direct = t.preds.where((F.col("variant") == "direct") & F.col("prob").isNotNull()).select(
        "row_id", "variant", F.concat(F.lit("It is "), F.col("prob").cast("string")).alias("text"),
        "prob", "outcome", target, "market")
    wide = judging.side_by_side(
        base.unionByName(direct), answer_region(F.col("text")), ["base", "direct"])
    return wide.select(
        "row_id", "outcome", "target", "market", F.col("base.prob").alias("base_prob"),
        F.col("base.answer_tail").alias("base_tail"), F.col("direct.prob").alias("direct_prob"),
        F.col("direct.answer_tail").alias("direct_tail"))


@query("tail_head_views", """SELECT doc_id, left(text, 200) AS head, right(text, 200) AS tail,
  CAST(length(text) AS INT) AS chars FROM documents""")
def tail_head_views(t: Tables):
    views = judging.tail_head_views(t.read("documents"), F.col("text"))
    return views.select("doc_id", "head", "tail", "chars")


@query("judged_source_sink", with_views(
    f"""SELECT j.row_id, j.label, j.mode, j.parsed_prob, j.ok AS parse_ok, j.usable,
        {', '.join(f'j.{c}' for c in BOOLEAN_CATEGORIES)}, j.faithfulness, t.score
        FROM judged j JOIN truth t ON j.row_id = t.row_id""", "audits", judged=JUDGED, truth=TRUTH))
def judged_source_sink(t: Tables):
    path = run_folder(t.spark, "judged")
    # Whole ground truths are many times the file that they are estimated by: never broadcast.
    truth = truths(t).withColumnRenamed("truth", "ground_truth").hint("merge")
    rows = judged(t).join(truth, "row_id")
    judged_source.write_judged(rows.withColumn("text", F.col("reply")), path)
    v = F.col("verdict")
    return judged_source.read_judged(t.spark, path).select(
        "row_id", "label", "mode", "parsed_prob", v["parse_ok"].alias("parse_ok"),
        v["usable"].alias("usable"), *[v[c]["v"].alias(c) for c in BOOLEAN_CATEGORIES],
        v["faithfulness"]["v"].alias("faithfulness"), F.col("ground_truth.score").alias("score"))
