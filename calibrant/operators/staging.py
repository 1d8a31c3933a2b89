"""Columns that are computed once, whatever follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions import audit, extract, scoring


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of repeating.

    The optimizer moves a filter below the projection that defines its column and so evaluates a
    costly expression twice. It does not move one below a generator, and this one gives exactly one
    row per row.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(values)))


def with_probability(df: DataFrame, text: str = "text", name: str = "prob",
                     reasoning: str | None = None) -> DataFrame:
    """Add the probability read from ``text``, or from the text with its reasoning in front."""
    region = computed_once(df, _region=extract.answer_region(F.col(text)))
    found = extract.region_probability(F.col("_region"), F.col(text))
    if reasoning:
        found = F.coalesce(found, extract.reasoned_probability(F.col(text), F.col(reasoning)))
    return computed_once(region, **{name: found}).drop("_region")


def reward_stage(use_soft_target: bool = True, **options) -> Callable[..., DataFrame]:
    """A reward with its options bound: ``stage(df, text, outcome, target)`` adds the reward struct.

    The answer region is found once per row; ``score_reward_fn`` does the same as a column, which
    repeats that per tier.
    """

    def stage(df: DataFrame, text: str = "text", outcome: str = "outcome", target: str | None = None,
              name: str = "reward") -> DataFrame:
        goal = F.col(target) if target and use_soft_target else None
        found = with_probability(df, text, "_reward_prob")
        return found.withColumn(name, scoring.score_reward(
            F.col("_reward_prob"), F.col(outcome), goal, **options)).drop("_reward_prob")

    return stage


def with_verdict(df: DataFrame, reply: str = "reply", strict: bool = True) -> DataFrame:
    """Add the parsed verdict of a reply."""
    cut = computed_once(df, _cut=audit.verdict_json(F.col(reply)))
    parsed = computed_once(cut, _array=audit.verdict_array(F.col("_cut"), strict))
    node = audit.verdict_node(F.col("_cut"), F.col("_array"))
    fields = audit.verdict_fields(F.col("_cut"), node, strict)
    return parsed.withColumn("verdict", fields).drop("_cut", "_array")
