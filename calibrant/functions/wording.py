"""The natural-language form of a game state, clause by clause."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibrant.functions.numbers import fixed_text, nearest_int

# Instruction sentences at the end of a prompt, one per mode.
INSTRUCTIONS = {
    "cot": "Reason step by step, then give a final probability as a percentage.",
    "direct": "Respond with ONLY the win probability as a percentage and nothing else"
              " (for example: 63%).",
    "masked": "Reason step by step. Then, on a new line, give your final answer in exactly this"
              " format: Probability: NN%   (NN = the win probability).",
}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def ordinal(n: Column) -> Column:
    n = n.cast("int")
    suffix = F.when(n == 1, "st").when(n == 2, "nd").when(n == 3, "rd").otherwise("th")
    return _text(n, suffix)


def field_position_text(yards_to_goal: Column, defteam: Column) -> Column:
    y = nearest_int(yards_to_goal)
    return (
        F.when(y.isNull(), "field position unknown")
        .when(y < 50, _text("at the ", defteam, " ", y, " yard line (opponent territory)"))
        .when(y == 50, "at midfield (the 50)")
        .otherwise(_text("at their own ", 100 - y, " yard line"))
    )


def score_clause(score_difference: Column) -> Column:
    d = nearest_int(score_difference)
    return (
        F.when(d > 0, _text("leading by ", d))
        .when(d < 0, _text("trailing by ", -d))
        .otherwise("tied")
    )


def possession_line(spread_line: Column, posteam: Column, home_team: Column) -> Column:
    """The home-signed line as points the side in possession is favoured by."""
    line = spread_line.cast("double")
    return F.when(posteam.eqNullSafe(home_team), line).otherwise(-line)


def spread_clause(spread_line: Column, posteam: Column, home_team: Column) -> Column:
    line = possession_line(spread_line, posteam, home_team)
    side = F.when(line > 0, " favored by ").otherwise(" underdogs by ")
    words = F.when(F.abs(line) < 1e-6, "pick'em").otherwise(
        _text(posteam, side, fixed_text(F.abs(line), 1)))
    return F.when(line.isNull(), "").otherwise(_text("\n- Pregame line: ", words))


def player_clause(
    passer: Column, passing_yards: Column, rusher: Column, rushing_yards: Column
) -> Column:
    def yards(count: Column, kind: str) -> Column:
        return F.coalesce(_text(" (", count.cast("int"), f" {kind} yds so far)"), F.lit(""))

    quarterback = F.when(passer != "", _text(passer, " at QB", yards(passing_yards, "pass")))
    runner = F.when(rusher != "", _text("lead back ", rusher, yards(rushing_yards, "rush")))
    people = F.concat_ws("; ", quarterback, runner)
    return F.when(people == "", "").otherwise(_text("\n- Personnel on the play: ", people))


def clock_clause(quarter: Column, clock: Column) -> Column:
    shown = F.coalesce(F.when(clock != "", clock), F.lit("??:??"))
    return (
        F.when(quarter.isNull(), _text(shown, " left"))
        .when(quarter == 5, _text("Overtime, ", shown, " left in overtime"))
        .otherwise(_text(ordinal(quarter), " quarter, ", shown, " left in the quarter"))
    )


def down_clause(down: Column, to_go: Column) -> Column:
    return F.when(down.isNull(), "between plays").otherwise(
        _text(ordinal(down), " and ", to_go.cast("int")))


def render_prompt() -> Column:
    """The whole question, from the columns of a raw play."""
    c = F.col
    return F.concat(
        _text("NFL game: ", c("posteam"), " (possession) vs ", c("defteam"), ".\n- "),
        clock_clause(c("qtr"), c("time")),
        _text("\n- ", c("posteam"), " "), score_clause(c("score_differential")),
        F.lit("\n- "), down_clause(c("down"), c("ydstogo")),
        F.lit(", ball "), field_position_text(c("yardline_100"), c("defteam")),
        spread_clause(c("spread_line"), c("posteam"), c("home_team")),
        player_clause(c("passer_player_name"), c("passing_yards"),
                      c("rusher_player_name"), c("rushing_yards")),
        _text("\n\nQuestion: What is the probability that ", c("posteam"), " win this game? ",
              INSTRUCTIONS["cot"]),
    )


def prompt_mode(prompt: Column, mode: Column | str) -> Column:
    """Swap the step-by-step instruction for the one of ``mode``; unknown modes keep it."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    wanted = F.when(mode == "direct", INSTRUCTIONS["direct"]).when(
        mode == "masked", INSTRUCTIONS["masked"]).otherwise(INSTRUCTIONS["cot"])
    return F.replace(prompt, F.lit(INSTRUCTIONS["cot"]), wanted)
