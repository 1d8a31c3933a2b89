"""Fragments shared by the checking SQL. They restate the operators in plain SQL."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Fixed values, written out here again so that a wrong one in the operators shows.
SCORE_EDGES = (-21, -14, -10, -7, -4, -1, 0, 1, 4, 7, 10, 14, 21)
TIME_EDGES = (120, 300, 600, 900, 1800, 2700)
SPREAD_EDGES = (-10, -7, -3, -0.5, 0.5, 3, 7, 10)
FIELD_EDGES = (10, 20, 40, 60, 80)
POISSON_STEPS = (
    1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777,
    4294923276, 4294962463, 4294966817, 4294967252, 4294967292, 4294967295)
SEED_0 = 3486326916  # the first eight digits of md5('0'), as a number

def bins(x: str, edges: Sequence[float]) -> str:
    return "(" + " + ".join(f"CAST({x} >= {float(e)!r}e0 AS INT)" for e in edges) + ")"


def grid_bin(p: str, n: int = 10) -> str:
    return bins(p, np.linspace(0, 1, n + 1)[1:-1])


def stats(source: str, by: str = "variant", p: str = "prob", y: str = "outcome",
          bin_sql: str | None = None) -> str:
    return f"""SELECT {by}, {bin_sql or grid_bin(p)} AS bin, count(*) AS n, sum({p}) AS sp,
      CAST(sum({y}) AS DOUBLE) AS sy, sum(({p} - {y}) * ({p} - {y})) AS sq,
      sum({y} * ln(least(greatest({p}, 1e-12), 1 - 1e-12))
          + (1 - {y}) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12))) AS sl,
      count(*) FILTER (WHERE ({p} > 0.5e0) = ({y} = 1)) AS hits
      FROM {source} WHERE {p} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL"""


METRICS = {
    "n": "CAST(sum(n) AS BIGINT)",
    "brier": "round(sum(sq) / sum(n) + 1e-12, 9)",
    "log_loss": "round(-sum(sl) / sum(n) + 1e-12, 9)",
    "accuracy": "round(sum(hits) / sum(n) + 1e-12, 9)",
    "ece": "round(sum(n * abs(sp / n - sy / n)) / sum(n) + 1e-12, 9)",
    "mce": "round(max(abs(sp / n - sy / n)) + 1e-12, 9)",
    "reliability": "round(sum(n * (sp / n - sy / n) ** 2) / sum(n) + 1e-12, 9)",
    "resolution": "round(sum(n * (sy / n - base) ** 2) / sum(n) + 1e-12, 9)",
    "uncertainty": "round(max(base) * (1 - max(base)) + 1e-12, 9)",
    "brier_check": "round(sum(n * (sp / n - sy / n) ** 2) / sum(n)"
                   " - sum(n * (sy / n - base) ** 2) / sum(n) + max(base) * (1 - max(base)) + 1e-12, 9)",
    "mean_prob": "round(sum(sp) / sum(n) + 1e-12, 9)",
    "base_rate": "round(max(base) + 1e-12, 9)",
}


def metrics(names: Sequence[str], source: str = "stats", by: str = "variant") -> str:
    shown = ", ".join(f"{METRICS[n]} AS {n}" for n in names)
    return f"""SELECT {by}, {shown} FROM (
      SELECT *, sum(sy) OVER (PARTITION BY {by}) / sum(n) OVER (PARTITION BY {by}) AS base
      FROM {source}) m GROUP BY {by}"""


POSSESSION_LINE = "CASE WHEN posteam = home_team THEN spread_line ELSE -spread_line END"

# Keys of the coarse and the fine rate table, from the columns of ``labelled``.
STATE_KEYS = {
    "score_bin": bins("score_differential", SCORE_EDGES),
    "time_bin": bins("game_seconds_remaining", TIME_EDGES),
    "spread_bin": bins(f"coalesce({POSSESSION_LINE}, 0)", SPREAD_EDGES),
    "field_bin": bins("coalesce(yardline_100, 50)", FIELD_EDGES),
    "down_bin": "coalesce(down, 0)",
}
COARSE = list(STATE_KEYS)[:3]
FINE = list(STATE_KEYS)


def keyed(source: str = "labelled") -> str:
    shown = ", ".join(f"{sql} AS {name}" for name, sql in STATE_KEYS.items())
    return f"SELECT *, {shown} FROM {source}"


def rate_levels(prefix: str, names: Sequence[str], source: str = "keyed",
                m: float = 25.0) -> dict[str, str]:
    """One common table expression per level, named ``{prefix}0``, ``{prefix}1``, ..."""
    train = f"FROM {source} WHERE split = 'train'"
    levels = {f"{prefix}0": f"SELECT CAST(sum(outcome) AS BIGINT) AS wins, count(*) AS n,"
                            f" sum(outcome) / count(*) AS phat {train}"}
    for depth in range(1, len(names) + 1):
        keys = list(names[:depth])
        on = " AND ".join(f"c.{k} = p.{k}" for k in keys[:-1]) or "TRUE"
        levels[f"{prefix}{depth}"] = f"""SELECT c.*, (c.wins + {m} * p.phat) / (c.n + {m}) AS phat
          FROM (SELECT {', '.join(keys)}, CAST(sum(outcome) AS BIGINT) AS wins, count(*) AS n
                {train} GROUP BY ALL) c JOIN {prefix}{depth - 1} p ON {on}"""
    return levels


def looked_up(prefix: str, names: Sequence[str], rows: str, keep: str, out: str,
              decimals: int | None = None) -> str:
    """Rows of ``rows`` with the deepest rate; ``keep`` are columns of alias ``r``."""
    joins, rates, depths = [], [], []
    for depth in range(len(names), 0, -1):
        a = f"{prefix}{depth}"
        on = " AND ".join(f"r.{k} = {a}.{k}" for k in names[:depth])
        joins.append(f"LEFT JOIN {a} ON {on}")
        rates.append(f"{a}.phat")
        depths.append(f"WHEN {a}.phat IS NOT NULL THEN {depth}")
    rate = f"coalesce({', '.join(rates)}, {prefix}0.phat)"
    if decimals is not None:
        rate = f"CAST(printf('%.{decimals}f', {rate}) AS DOUBLE)"
    return f"""SELECT {keep}, {rate} AS {out},
      CASE {' '.join(depths)} ELSE 0 END AS {out}_level
      FROM {rows} r CROSS JOIN {prefix}0 {' '.join(joins)}"""


# Text clauses of a rendered question. The wording is fixed.
ORDINAL = """CASE {n} WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' WHEN 4 THEN '4th'
  ELSE concat(CAST({n} AS STRING), 'th') END"""
FIELD_TEXT = """CASE WHEN yardline_100 IS NULL THEN 'field position unknown'
  WHEN yardline_100 = 50 THEN 'at midfield (the 50)'
  WHEN yardline_100 > 50 THEN concat('at their own ', 100 - yardline_100, ' yard line')
  ELSE concat('at the ', defteam, ' ', yardline_100, ' yard line (opponent territory)') END"""
SCORE_TEXT = """CASE WHEN score_differential > 0 THEN concat('leading by ', score_differential)
  WHEN score_differential < 0 THEN concat('trailing by ', abs(score_differential))
  ELSE 'tied' END"""
SPREAD_TEXT = f"""CASE WHEN spread_line IS NULL THEN ''
  WHEN spread_line = 0 THEN concat(chr(10), '- Pregame line: pick''em')
  WHEN {POSSESSION_LINE} > 0
  THEN concat(chr(10), '- Pregame line: ', posteam, ' favored by ', printf('%.1f', abs(spread_line)))
  ELSE concat(chr(10), '- Pregame line: ', posteam, ' underdogs by ',
              printf('%.1f', abs(spread_line))) END"""
PASSER_TEXT = """concat(passer_player_name, ' at QB', CASE WHEN passing_yards IS NULL THEN ''
  ELSE concat(' (', CAST(trunc(passing_yards) AS INT), ' pass yds so far)') END)"""
RUSHER_TEXT = """concat('lead back ', rusher_player_name, CASE WHEN rushing_yards IS NULL THEN ''
  ELSE concat(' (', CAST(trunc(rushing_yards) AS INT), ' rush yds so far)') END)"""
PLAYER_TEXT = f"""CASE
  WHEN coalesce(passer_player_name, '') <> '' AND coalesce(rusher_player_name, '') <> ''
  THEN concat(chr(10), '- Personnel on the play: ', {PASSER_TEXT}, '; ', {RUSHER_TEXT})
  WHEN coalesce(passer_player_name, '') <> ''
  THEN concat(chr(10), '- Personnel on the play: ', {PASSER_TEXT})
  WHEN coalesce(rusher_player_name, '') <> ''
  THEN concat(chr(10), '- Personnel on the play: ', {RUSHER_TEXT}) ELSE '' END"""
CLOCK_TEXT = f"""CASE WHEN qtr = 5
  THEN concat('Overtime, ', coalesce(time, '??:??'), ' left in overtime')
  ELSE concat({ORDINAL.format(n='qtr')}, ' quarter, ', coalesce(time, '??:??'),
              ' left in the quarter') END"""
DOWN_TEXT = f"""CASE WHEN down IS NULL THEN 'between plays'
  ELSE concat({ORDINAL.format(n='down')}, ' and ', ydstogo) END"""
STEP_BY_STEP = "Reason step by step, then give a final probability as a percentage."
PROMPT = f"""concat('NFL game: ', posteam, ' (possession) vs ', defteam, '.', chr(10), '- ',
  {CLOCK_TEXT}, chr(10), '- ', posteam, ' ', {SCORE_TEXT}, chr(10), '- ', {DOWN_TEXT}, ', ball ',
  {FIELD_TEXT}, {SPREAD_TEXT}, {PLAYER_TEXT}, chr(10), chr(10),
  'Question: What is the probability that ', posteam, ' win this game? {STEP_BY_STEP}')"""

# Probability extraction. Non-ASCII letters and digits are mapped to an ASCII letter and Unicode
# blanks to a blank first, because this engine's word edges and blanks are ASCII.
_NUMBER = r"(-?[0-9]*\.[0-9]+|-?[0-9]+(?:\.[0-9]+)?)"
_PERCENT = r"(-?[0-9]+(?:\.[0-9]+)?)\s*%"
_CUE = (r"(?i)\b(?:final\s+probability|final\s+answer|win\s+probability|"
        r"probability(?:\s+(?:is|of))?|answer)\b\s*[:=]?\s*")


def ascii_words(text: str) -> str:
    letters = rf"regexp_replace({text}, '[^\x00-\x7F\PL]', 'x', 'g')"
    digits = rf"regexp_replace({letters}, '[^\x00-\x7F\PN]', 'x', 'g')"
    return rf"regexp_replace({digits}, '[^\x00-\x7F\PZ]', ' ', 'g')"


def region(text: str) -> str:
    return rf"""CASE WHEN contains(lower({text}), '</think>')
      THEN regexp_replace({text}, '(?is)^.*</think>', '')
      ELSE regexp_replace({text}, '(?is)<think>.*$', ' ') END"""


def _valid(raw_list: str, percent: bool) -> str:
    value = "CAST(r AS DOUBLE) / 100" if percent else \
        "CASE WHEN CAST(r AS DOUBLE) > 1 THEN CAST(r AS DOUBLE) / 100 ELSE CAST(r AS DOUBLE) END"
    kept = f"list_filter({raw_list}, lambda r: r <> '')"
    return (f"list_filter(list_transform({kept}, lambda r: {value}),"
            " lambda v: v BETWEEN 0 AND 1)[-1]")


def scan(text: str) -> str:
    first = f"list_transform(regexp_split_to_array({text}, '{_CUE}')[2:]," \
            f" lambda s: regexp_extract(s, '{_NUMBER}', 1))"
    return f"""coalesce({_valid(f"regexp_extract_all({text}, '{_PERCENT}', 1)", True)},
      {_valid(first, False)}, {_valid(f"regexp_extract_all({text}, '{_NUMBER}', 1)", False)})"""


def extracted(source: str, text: str, keep: str, out: str = "prob") -> str:
    """``keep`` and the probability of ``text``, for every row of ``source``."""
    return f"""SELECT {keep}, coalesce({scan('_region')}, {scan('_whole')}) AS {out}
      FROM (SELECT *, {ascii_words(region(text))} AS _region, {ascii_words(text)} AS _whole
            FROM {source}) s"""


def json_cut(reply: str) -> str:
    fenced = f"CASE WHEN starts_with(trim({reply}), '```') THEN split_part(trim({reply}), '```', 2)" \
             f" ELSE {reply} END"
    return rf"nullif(regexp_extract({fenced}, '(?s)\{{.*\}}', 0), '')"


def replicate_sums(source: str, by: str, values: Sequence[str], reps: int) -> str:
    """Weighted sums per group and replicate of ``source``, which has a ``row_id``; seed 0."""
    bucket = "CAST(concat('0x', substr(md5(concat('0|', row_id)), 1, 8)) AS BIGINT) % 1024"
    weight = " + ".join(f"CAST(u >= {step} AS INT)" for step in POISSON_STEPS)
    mask = 4294967295
    sums = ", ".join(f"sum(CAST({v} AS DOUBLE)) AS {v}" for v in values)
    weighted = ", ".join(f"sum(w * {v}) AS {v}" for v in values)
    return f"""SELECT {by}rep, CAST(sum(w * rows) AS DOUBLE) AS weight, {weighted}
      FROM (SELECT {by}{bucket} AS bucket, count(*) AS rows, {sums} FROM {source} GROUP BY ALL) s
      JOIN (SELECT rep, bucket, {weight} AS w FROM (
        SELECT rep, bucket, xor(x, x >> 16) AS u FROM (
          SELECT rep, bucket, (xor(x, x >> 15) * 2221713035) & {mask} AS x FROM (
            SELECT rep, bucket, (xor(x, x >> 16) * 2146121005) & {mask} AS x FROM (
              SELECT rep, bucket, CAST(({SEED_0} + rep * 1024 + bucket) & {mask} AS UBIGINT) AS x
              FROM generate_series(0, {reps - 1}) r(rep), generate_series(0, 1023) b(bucket))))) x
      ) d USING (bucket) GROUP BY ALL"""


def interval(column: str, name: str) -> str:
    return (f"round(quantile_cont({column}, 0.025) + 1e-12, 9) AS {name}lo,"
            f" round(quantile_cont({column}, 0.975) + 1e-12, 9) AS {name}hi")
