"""Read one probability out of free text.

Tiers, first hit wins: the last valid percentage; the first number after the last cue phrase for
which that number is valid; the last valid bare number. The tiers run on the answer region and, if
that holds nothing, on the whole text. A percentage is divided by 100, a bare number only when it
is above 1; what is then outside [0, 1] does not count.

The cue tier needs no look-behind: cutting the text at the cues gives one piece after each cue, and
the first number after a cue is the first number of the nearest later piece that has one. So the
tier's answer is the last piece whose own first number is valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number, percentage and cue patterns (digits ASCII, word edges and blanks Unicode).
NUMBER_PATTERN = r"(-?[0-9]*\.[0-9]+|-?[0-9]+(?:\.[0-9]+)?)"
PERCENT_PATTERN = r"(?U)(-?[0-9]+(?:\.[0-9]+)?)\s*%"
CUE_PATTERN = (
    r"(?iU)\b(?:final\s+probability|final\s+answer|win\s+probability|"
    r"probability(?:\s+(?:is|of))?|answer)\b\s*[:=]?\s*"
)
THINK_CLOSE_PATTERN = r"(?is)^.*</think>"
THINK_OPEN_PATTERN = r"(?is)<think>.*$"
# Fixed value: what opens the answer span of a completion.
ANSWER_MARKER = "Probability:"


def answer_region(text: Column) -> Column:
    """The text after the last closing think tag, or before an opening tag that never closes."""
    closed = F.contains(F.lower(text), F.lit("</think>"))
    return F.coalesce(
        F.when(closed, F.regexp_replace(text, THINK_CLOSE_PATTERN, "")).otherwise(
            F.regexp_replace(text, THINK_OPEN_PATTERN, " ")),
        F.lit(""),
    )


def coerce_prob(raw: Column, is_percent: bool) -> Column:
    value = raw.try_cast("double")
    share = value / 100 if is_percent else F.when(value > 1, value / 100).otherwise(value)
    return F.when(share.between(0.0, 1.0), share)


def _last_valid(raw_numbers: Column, is_percent: bool) -> Column:
    values = F.transform(raw_numbers, lambda raw: coerce_prob(raw, is_percent))
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))


def scan_probability(text: Column) -> Column:
    """The three tiers on one text."""
    percents = F.regexp_extract_all(text, F.lit(PERCENT_PATTERN), F.lit(1))
    after_cues = F.slice(F.split(text, CUE_PATTERN, -1), 2, 2147483647)
    first_numbers = F.transform(after_cues, lambda s: F.regexp_extract(s, NUMBER_PATTERN, 1))
    numbers = F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(1))
    return F.coalesce(
        _last_valid(percents, True),
        _last_valid(first_numbers, False),
        _last_valid(numbers, False),
    )


def region_probability(region: Column, text: Column) -> Column:
    """The tiers on the answer region, then on the whole text where that differs."""
    # A text without any digit has nothing to find, and most prose has none: test that first.
    found = F.coalesce(scan_probability(region), F.when(region != text, scan_probability(text)))
    return F.when(text.rlike("[0-9]"), found)


def extract_probability(text: Column) -> Column:
    return region_probability(answer_region(text), text)


def with_reasoning(text: Column, reasoning: Column) -> Column:
    """The completion with its separately delivered reasoning put back in front."""
    text = F.coalesce(text, F.lit(""))
    return F.when(
        reasoning != "", F.concat(F.lit("<think>"), reasoning, F.lit("</think>\n"), text)
    ).otherwise(text)


def reasoned_probability(text: Column, reasoning: Column) -> Column:
    """What the text with its reasoning in front gives; NULL without reasoning."""
    return F.when(reasoning != "", extract_probability(with_reasoning(text, reasoning)))


def response_probability(text: Column, reasoning: Column) -> Column:
    return F.coalesce(extract_probability(text), reasoned_probability(text, reasoning))


def is_truncated(finish_reason: Column) -> Column:
    return finish_reason.eqNullSafe(F.lit("length"))


def completion_text(messages: Column) -> Column:
    """Content of the last message of a chat completion; empty without messages."""
    return F.coalesce(F.get(messages, F.size(messages) - 1)["content"], F.lit(""))


def answer_prefix(text: Column, marker: str = ANSWER_MARKER) -> Column:
    """Text before the last marker, NULL without one."""
    size = len(marker)
    behind = F.instr(F.reverse(text), F.lit(marker[::-1]))
    return F.when(behind > 0, F.substring(text, F.lit(1), F.length(text) - behind - size + 1))


def token_count(text: Column) -> Column:
    """Tokens between blanks."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"(?U)\s+")))


def answer_span(
    text: Column, marker: str = ANSWER_MARKER, count: Callable[[Column], Column] = token_count
) -> Column:
    """Where the answer starts, in tokens, and which share of the tokens belongs to it.

    Without a marker, or when nothing follows the prefix, the whole text counts as answer. ``count``
    may be a vectorized function of a tokenizer.
    """
    prefix = count(answer_prefix(text, marker))
    total = count(text)
    whole = prefix.isNull() | (prefix >= total)
    kept = F.when(whole, total).otherwise(total - prefix)
    return F.struct(
        prefix.alias("prefix_tokens"),
        total.alias("total_tokens"),
        kept.alias("answer_tokens"),
        F.when(total > 0, kept / total).alias("answer_share"),
    )
