"""Several forecasters on the same items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.numbers import clipped
from calibrant.operators.cleaning import clean_predictions, demanded


def _sides(preds: DataFrame, a: str, b: str, row_id: str) -> DataFrame:
    """One row per item of either variant, with what is wrong about its pairing in ``fault``."""
    is_a, is_b = F.col("variant") == a, F.col("variant") == b
    n_a, n_b = F.count_if(is_a), F.count_if(is_b)

    def differs(name: str) -> Column:
        return ~F.min(F.when(is_a, F.col(name))).eqNullSafe(F.min(F.when(is_b, F.col(name))))

    fault = (
        F.when(F.any_value(F.col(row_id)).isNull(), "no id")
        .when((n_a > 1) | (n_b > 1), "repeated")
        .when(n_a == 0, "not in the first").when(n_b == 0, "not in the second")
        .when(differs("outcome"), "outcomes differ").when(differs("market"), "markets differ"))
    return preds.where(is_a | is_b).groupBy(row_id).agg(
        F.max(F.when(is_a, F.col("prob"))).alias("a"),
        F.max(F.when(is_b, F.col("prob"))).alias("b"),
        F.max("market").alias("market"), F.max("outcome").alias("outcome"), fault.alias("fault"))


def paired_join(
    preds: DataFrame, a: str, b: str, row_id: str = "row_id", both_parsed: bool = True
) -> DataFrame:
    """Two variants of a long prediction table side by side: ``row_id, a, b, market, outcome``.

    Both variants go through one shuffle on the row id. Reading an item that only one variant has, has
    twice, or with another outcome or market price raises an error. Only items that both parsed are
    kept, unless ``both_parsed`` is off.
    """
    sides = _sides(preds, a, b, row_id)
    message = F.concat(F.lit("misaligned item: "), F.col("fault"))
    sides = demanded(sides, F.col("fault").isNull(), message).drop("fault")
    return sides.where(F.col("a").isNotNull() & F.col("b").isNotNull()) if both_parsed else sides


def pairing_violations(preds: DataFrame, a: str, b: str, row_id: str = "row_id") -> DataFrame:
    """``(row_id, fault)`` of every item that ``paired_join`` refuses."""
    return _sides(preds, a, b, row_id).where(F.col("fault").isNotNull()).select(row_id, "fault")


def align_models(preds: DataFrame, variants: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """One row per item, one clipped probability column per variant, and ``aligned``.

    ``aligned`` is false where a variant is missing or repeated, or the outcomes disagree.
    """
    wide = {
        v: F.max(F.when(F.col("variant") == v, clipped(F.col("prob"))))
        for v in variants}
    present = preds.where(F.col("variant").isin(*variants))
    once = F.lit(True)
    for variant in variants:
        once = once & (F.count_if(F.col("variant") == variant) == 1)
    return present.groupBy(row_id).agg(
        F.min("outcome").alias("outcome"),
        *[column.alias(v) for v, column in wide.items()],
        (once & (F.min("outcome") == F.max("outcome")) & (F.count("outcome") == len(variants)))
        .alias("aligned"),
    )


def alignment_violations(preds: DataFrame, variants: Sequence[str]) -> DataFrame:
    return align_models(preds, variants).where(~F.coalesce("aligned", F.lit(False)))


def aligned_models(preds: DataFrame, variants: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """``align_models`` for input that must be aligned: reading any other item raises an error."""
    wide = align_models(preds, variants, row_id)
    return demanded(wide, F.coalesce("aligned", F.lit(False)),
                    F.concat(F.lit("misaligned item: "), F.col(row_id).cast("string"))).drop("aligned")


def features_join(scored: DataFrame, features: DataFrame, row_id: str = "row_id",
                  outcome: str = "actual_outcome", strict: bool = True) -> DataFrame:
    """Every scored row with its features; ``outcome_agrees`` tells whether both sides agree.

    A row without features, or whose outcome differs, raises an error when it is read; with
    ``strict`` off it stays, with NULL features. Repeated features are an error either way.
    """
    right = features.withColumnRenamed(outcome, "_outcome").withColumn("_there", F.lit(True))
    names = [c for c in right.columns if c != row_id]
    once = right.groupBy(row_id).agg(
        F.any_value(F.struct(*names)).alias("_f"), F.count(F.lit(1)).alias("_n"))
    once = demanded(once, (F.col("_n") == 1) | F.col(row_id).isNull(),
                    "features come twice for one row").drop("_n")
    joined = scored.join(once, row_id, "left").select(
        *scored.columns, *[F.col(f"_f.{n}").alias(n) for n in names]).withColumn(
        "outcome_agrees", F.col("_there").isNotNull() & F.col(outcome).eqNullSafe(F.col("_outcome")))
    if strict:
        joined = demanded(joined, F.col("outcome_agrees"),
                          "a scored row has no features, or another outcome")
    return joined.drop("_outcome", "_there")


def long_forecasts(df: DataFrame, forecasts: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """Forecast columns of one table stacked to ``(keep..., variant, prob)`` in one scan."""
    lines = [F.struct(F.lit(name).alias("variant"), column.cast("double").alias("prob"))
             for name, column in forecasts.items()]
    return df.select(*keep, F.inline(F.array(*lines)))


def market_on_same_items(preds: DataFrame, suffix: str = ":market") -> DataFrame:
    """Each variant's clean rows, and the market scored on exactly these rows."""
    lines = F.array(
        F.struct(F.col("variant"), F.col("prob")),
        F.struct(F.concat("variant", F.lit(suffix)).alias("variant"),
                 F.col("market").alias("prob")))
    return clean_predictions(preds).select(
        "row_id", "outcome", F.explode(lines).alias("_line")
    ).select("row_id", "outcome", "_line.variant", "_line.prob")


def union_variants(*frames: DataFrame) -> DataFrame:
    """Long prediction tables one under another."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
