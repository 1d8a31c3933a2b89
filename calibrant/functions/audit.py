"""True game state, audit requests and audit verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibrant.functions.numbers import double_text, fixed_text, nearest_int
from calibrant.functions.parsing import LINE_PATTERN, PICKEM_PATTERN
from calibrant.schemas import BOOLEAN_CATEGORIES

# The system message of an audit request, the instruction at its end, and the one for a
# second try.
SYSTEM_MESSAGE = (
    "You are an expert NFL analyst auditing a win-probability forecaster's written reasoning "
    "for FACTUAL errors against the TRUE game state you are given. Be strict and literal. "
    "Flag an error ONLY when the reasoning explicitly states something that contradicts the "
    "true state — never for a mere omission. Output ONLY a single JSON object, no prose.")
VERDICT_INSTRUCTION = """Return JSON exactly:
{
 "possession_misread": {"v": true|false, "q": "<verbatim quote or empty>"},
 "score_inversion":    {"v": true|false, "q": "..."},
 "spread_inversion":   {"v": true|false, "q": "..."},
 "clock_misread":      {"v": true|false, "q": "..."},
 "pregame_anchor":     {"v": true|false, "q": "..."},
 "faithfulness":       {"v": "consistent"|"inconsistent"|"unclear", "q": "<one-line why>"}
}
Definitions:
- possession_misread: says the wrong team has the ball.
- score_inversion: says the wrong team leads/trails (incl. "leading" when actually trailing).
- spread_inversion: treats the pregame favorite as the underdog, or vice versa.
- clock_misread: states the wrong quarter, or a materially wrong time remaining.
- pregame_anchor: bases the win-prob conclusion on the pregame line while ignoring/contradicting the
  CURRENT live score (e.g. calls a team that is currently LEADING unlikely to win because it was the
  pregame underdog). Only flag when the live score is non-tied and the reasoning lets the line override it.
- faithfulness: does the stated final probability follow from the reasoning's own conclusion?"""
REPAIR_INSTRUCTION = "\n\nReturn ONLY the JSON object."


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _shown(x: Column) -> Column:
    """Missing values are spelled out in a request."""
    return F.coalesce(x.cast("string"), F.lit("None"))


def audit_field_position(yards_to_goal: Column) -> Column:
    y = nearest_int(yards_to_goal)
    return (
        F.when(y <= 20, _text("opponent ", y, " (red zone)"))
        .when(y < 50, _text("opponent ", y))
        .when(y == 50, "midfield (50)")
        .when(y > 50, _text("own ", 100 - y))
        .otherwise("unknown")
    )


def audit_score_state(posteam: Column, score_difference: Column) -> Column:
    d = nearest_int(score_difference)
    direction = F.when(d > 0, " leading by ").when(d < 0, " trailing by ")
    return F.coalesce(_text(posteam, direction, F.abs(d)), F.lit("tied"))


def spread_struct(question: Column, posteam: Column) -> Column:
    """Pregame line as ``{side, team, points}``, read from the rendered question."""
    pickem = question.rlike(PICKEM_PATTERN)
    named = F.regexp_extract(question, LINE_PATTERN, 1)
    wording = F.regexp_extract(question, LINE_PATTERN, 2)
    points = F.regexp_extract(question, LINE_PATTERN, 3).try_cast("double")
    side = (
        F.when(pickem, "pickem").when(wording == "favored by", "favored")
        .when(wording == "underdogs by", "underdog").otherwise("unknown")
    )
    return F.struct(
        side.alias("side"),
        F.when(~pickem & (named != ""), named).otherwise(posteam).alias("team"),
        F.when(pickem, 0.0).otherwise(points).alias("points"),
    )


def ground_truth() -> Column:
    """The exact state of a question, from the columns of a QA record."""
    c, f = F.col, (lambda name: F.col("features")[name])
    period = F.when(f("qtr") >= 5, "overtime").otherwise(_text("Q", f("qtr")))
    return F.struct(
        c("game_id"), c("season"), c("week"),
        f("posteam").alias("posteam"), f("defteam").alias("defteam"),
        period.alias("period"), f("time").alias("clock"),
        audit_score_state(f("posteam"), f("score_differential")).alias("score"),
        nearest_int(f("score_differential")).alias("score_differential"),
        f("down").alias("down"), f("ydstogo").alias("ydstogo"),
        audit_field_position(f("yardline_100")).alias("field_position"),
        spread_struct(c("question"), f("posteam")).alias("spread"),
        f("vegas_wp").alias("vegas_wp"), c("target_prob"),
        c("actual_outcome").cast("int").alias("actual_outcome"),
    )


def stratum(truth: Column) -> Column:
    """``{phase, leverage, side}`` of a ground truth; up to 8 points is close."""
    phase = (
        F.when(truth["period"] == "overtime", "OT")
        .when(truth["period"].isin("Q1", "Q2"), "early").otherwise("late")
    )
    leverage = F.when(F.abs(truth["score_differential"]) <= 8, "close").otherwise("lopsided")
    return F.struct(
        phase.alias("phase"), leverage.alias("leverage"), truth["spread"]["side"].alias("side"))


def shown_number(x: Column) -> Column:
    return _shown(double_text(x))


def state_line(truth: Column) -> Column:
    """A ground truth on one line."""
    t, line = truth, truth["spread"]
    return _text(
        _shown(t["game_id"]), " | ", _shown(t["period"]), " ", _shown(t["clock"]), " | ",
        _shown(t["posteam"]), " ", t["score"], " | down ", _shown(t["down"]), "&",
        _shown(t["ydstogo"]), " | ", t["field_position"], " | spread ", _shown(line["team"]), " ",
        shown_number(line["points"]), " | phat=", _shown(fixed_text(t["target_prob"], 2)),
        " outcome=", _shown(t["actual_outcome"]))


def judge_request(truth: Column, text: Column, parsed_prob: Column, repair: bool = False) -> Column:
    """The blinded request: true state, reasoning, stated probability. No model label goes in."""
    line, t = truth["spread"], truth
    spread = (
        F.when(line["side"].isin("favored", "underdog"),
               _text(_shown(line["team"]), " ", line["side"], " by ",
                     _shown(double_text(line["points"]))))
        .when(line["side"] == "pickem", "pick'em").otherwise("unknown")
    )
    down = F.when(t["down"] != 0, _text(t["down"], " and ", _shown(t["ydstogo"])))
    reasoning = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return _text(
        "TRUE game state (ground truth):\n- Possession: ", _shown(t["posteam"]),
        " has the ball; opponent is ", _shown(t["defteam"]),
        "\n- Score: ", t["score"],
        "\n- Period: ", t["period"], ", ", _shown(t["clock"]), " left",
        "\n- Down & distance: ", F.coalesce(down, F.lit("n/a")),
        "\n- Field position: ", t["field_position"],
        "\n- Pregame line: ", spread,
        '\n\nFORECASTER REASONING:\n"""\n', reasoning, '\n"""\n\n',
        "The forecaster's final stated probability that ", _shown(t["posteam"]), " wins: ",
        _shown(double_text(parsed_prob)), "\n\n", VERDICT_INSTRUCTION,
        REPAIR_INSTRUCTION if repair else "",
    )


def judge_messages(
    truth: Column, text: Column, parsed_prob: Column, repair: bool = False
) -> Column:
    """The request as chat messages: the system message, then the request itself."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 judge_request(truth, text, parsed_prob, repair).alias("content")))


def verdict_json(reply: Column) -> Column:
    """The JSON object inside a reply: without a code fence, first brace to last; NULL if none."""
    fenced = reply.rlike(r"(?U)^\s*```")
    inside = F.try_element_at(F.split(reply, "```", -1), F.lit(2))
    cut = F.regexp_extract(F.when(fenced, inside).otherwise(reply), r"(?s)\{.*\}", 0)
    return F.when(cut != "", cut)


def _truthy(node: Column) -> Column:
    """Whether a JSON value counts as yes: true, a non-zero number, a non-empty text or container."""
    kind = F.schema_of_variant(node)
    as_text = F.try_variant_get(node, "$", "string")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(node, "$", "boolean"))
        .when(kind == "STRING", as_text != "")
        .when(kind.isNull() | (kind == "VOID"), False)
        .when(kind.isin("OBJECT<>", "ARRAY<VOID>"), F.length(F.to_json(node)) > 2)
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True)
        .otherwise(F.try_variant_get(node, "$", "double") != 0)
    )


_STRICT_JSON = {"allowSingleQuotes": "false"}


def _raw_verdict(flag: str) -> str:
    flags = ", ".join(f"{c}: struct<v: {flag}, q: string>" for c in BOOLEAN_CATEGORIES)
    return f"array<struct<{flags}, faithfulness: struct<v: string, q: string>>>"


def verdict_array(cut: Column, strict: bool = True) -> Column:
    """The object in ``cut`` as an array of one raw verdict struct, NULL or empty if malformed.

    A strict flag is a boolean field: the parser leaves it NULL for any other value and goes on.
    """
    kind = _raw_verdict("boolean" if strict else "variant")
    return F.from_json(_text("[", cut, "]"), kind, _STRICT_JSON)


def verdict_node(cut: Column, in_array: Column) -> Column:
    """The raw verdict struct, NULL unless ``cut`` is valid JSON as a whole.

    The parser stops after the first complete value, so text after it would pass. Inside an array it
    passes only if it starts with a closing bracket, and then not inside an object; a second element
    is what a comma leaves.
    """
    in_object = F.from_json(_text('{"x":', cut, "}"), "x string", _STRICT_JSON)
    whole = F.when(F.contains(cut, F.lit("]")), in_object["x"].isNotNull()).otherwise(True)
    return F.when(whole & (F.size(in_array) == 1), F.get(in_array, F.lit(0)))


def verdict_fields(cut: Column, node: Column, strict: bool = True) -> Column:
    """Verdict struct: ``parse_ok``, ``usable``, one ``{v, q}`` per category, the faithfulness label.

    A verdict is usable when its object is not empty. ``strict`` accepts only JSON booleans as
    flags. Otherwise any value is read by whether it is empty, so the text ``"false"`` counts as yes.
    """
    def flag(value: Column) -> Column:
        return value if strict else _truthy(value)

    fields = [node.isNotNull().alias("parse_ok"),
              (node.isNotNull() & ~cut.rlike(r"^\{\s*\}$")).alias("usable")]
    for category in BOOLEAN_CATEGORIES:
        part = node[category]
        fields.append(F.struct(flag(part["v"]).alias("v"), part["q"].alias("q")).alias(category))
    fields.append(node["faithfulness"].alias("faithfulness"))
    return F.struct(*fields)


def parse_verdict(reply: Column, strict: bool = True) -> Column:
    """Verdict struct of a reply; ``with_verdict`` parses each reply once where filters follow."""
    cut = verdict_json(reply)
    return verdict_fields(cut, verdict_node(cut, verdict_array(cut, strict)), strict)
