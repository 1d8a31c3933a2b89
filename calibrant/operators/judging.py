"""Audit requests, verdicts and rater agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.audit import shown_number, state_line
from calibrant.operators.joins import salted_join
from calibrant.operators.resampling import proportion_ci
from calibrant.schemas import BOOLEAN_CATEGORIES, FAITHFULNESS_LABELS


def fan_out_variants(rows: DataFrame, variants: Sequence[tuple[str, str]]) -> DataFrame:
    """Every row once per ``(label, mode)``; an in-row expansion, not a join."""
    lines = [F.struct(F.lit(label).alias("label"), F.lit(mode).alias("mode"))
             for label, mode in variants]
    return rows.select("*", F.inline(F.array(*lines)))


def judge_failures(judged: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Replies and how many of them held no verdict."""
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("verdict.parse_ok")).alias("failed"))


def verdict_flags() -> dict[str, Column]:
    """What a usable verdict can find, by name."""
    v = F.col("verdict")
    flags = {c: F.coalesce(v[c]["v"], F.lit(False)) for c in BOOLEAN_CATEGORIES}
    flags["faithfulness(inconsistent)"] = F.coalesce(
        v["faithfulness"]["v"] == "inconsistent", F.lit(False))
    return flags


def verdict_rates(
    judged: DataFrame, reps: int = 2000, seed: int = 0, row_id: str = "row_id",
) -> DataFrame:
    """Error rate with interval per category and label, over all usable verdicts."""
    return proportion_ci(judged.where(F.col("verdict.usable")), ["label"], verdict_flags(),
                         reps, seed, row_id)


def faithfulness_rates(
    judged: DataFrame, reps: int = 2000, seed: int = 0, row_id: str = "row_id",
) -> DataFrame:
    """Inconsistent verdicts among those whose faithfulness label is one of the three legal ones."""
    kind = F.col("verdict.faithfulness.v")
    return proportion_ci(judged.where(kind.isin(*FAITHFULNESS_LABELS)), ["label"],
                         {"inconsistent": kind == "inconsistent"}, reps, seed, row_id).drop("category")


def latest_labels(labels: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One hand label per key: the last one given."""
    rest = [c for c in labels.columns if c not in keys]
    return labels.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_l")).select(*keys, "_l.*")


def human_label_join(
    judged: DataFrame, labels: DataFrame, keys: Sequence[str] = ("game_id", "label"),
    order: str = "label_no", row_id: str = "row_id",
) -> DataFrame:
    """Usable verdicts with the hand label of their key, one row per verdict.

    A key may cover many verdicts, so the verdict side is salted by its row id.
    """
    hand = latest_labels(labels, keys, order)
    hand = hand.withColumnsRenamed({c: f"human_{c}" for c in BOOLEAN_CATEGORIES})
    v = F.col("verdict")
    flags = [F.coalesce(v[c]["v"], F.lit(False)).alias(f"judge_{c}") for c in BOOLEAN_CATEGORIES]
    verdicts = judged.where(v["usable"]).select(*keys, row_id, *flags)
    return salted_join(verdicts, hand, list(keys), "inner", row_id)


def rater_pairs(
    judged: DataFrame, labels: DataFrame, keys: Sequence[str] = ("game_id", "label"),
    order: str = "label_no",
) -> DataFrame:
    """``(category, a, b, pairs)``: how often hand label ``a`` met verdict ``b``.

    Verdicts are counted per key and flag pattern before the join, so a key brings at most 2^5 rows
    to it however many verdicts it has.
    """
    v = F.col("verdict")
    flags = [F.coalesce(v[c]["v"], F.lit(False)).alias(f"judge_{c}") for c in BOOLEAN_CATEGORIES]
    patterns = judged.where(v["usable"]).select(*keys, *flags).groupBy(
        *keys, *[f"judge_{c}" for c in BOOLEAN_CATEGORIES]).agg(F.count(F.lit(1)).alias("_n"))
    hand = latest_labels(labels, keys, order)
    lines = F.array(*[
        F.struct(F.lit(c).alias("category"),
                 F.coalesce(F.col(c), F.lit(False)).cast("int").alias("a"),
                 F.col(f"judge_{c}").cast("int").alias("b"))
        for c in BOOLEAN_CATEGORIES])
    return (
        patterns.join(hand, list(keys)).select("_n", F.inline(lines))
        .groupBy("category", "a", "b").agg(F.sum("_n").alias("pairs"))
    )


def category_marginals(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., value, n_a, n_b, n_both)`` over every value either rater used."""
    sides = F.array(
        F.struct(F.col("a").alias("value"), F.col("pairs").alias("_a"), F.lit(0).alias("_b")),
        F.struct(F.col("b").alias("value"), F.lit(0).alias("_a"), F.col("pairs").alias("_b")))
    same = F.when(F.col("a").eqNullSafe(F.col("b")), F.col("_a")).otherwise(0)
    return pairs.select(*by, "a", "b", F.inline(sides)).groupBy(*by, "value").agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(same).alias("n_both"))


def agreement(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percent agreement and Cohen's kappa from counted pairs; kappa is 1 when chance is certain."""
    n = F.sum("n_a").cast("double")
    observed = F.sum("n_both") / n
    expected = F.sum(F.col("n_a").cast("double") * F.col("n_b")) / (n * n)
    kappa = F.when(expected < 1, F.try_divide(observed - expected, 1 - expected)).otherwise(1.0)
    return category_marginals(pairs, by).groupBy(*by).agg(
        F.sum("n_a").alias("n"), observed.alias("agree"), kappa.alias("kappa"))


def count_pairs(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).alias("pairs"))


def flip_examples(judged: DataFrame, a: str, b: str, row_id: str = "row_id") -> DataFrame:
    """Items where variant ``a`` reasons inconsistently and ``b`` consistently, with both reasons.

    Only the two verdict kinds that can make a flip reach the shuffle.
    """
    kind = F.col("verdict.faithfulness.v")
    is_a = (F.col("label") == a) & (kind == "inconsistent")
    is_b = (F.col("label") == b) & (kind == "consistent")

    def side(flag: Column, name: str) -> Column:
        return F.max(F.when(flag, F.struct(
            F.col("parsed_prob").alias("prob"), F.col("verdict.faithfulness.q").alias("why")))
        ).alias(name)

    return (
        judged.where(is_a | is_b)
        .groupBy(row_id).agg(F.any_value("ground_truth").alias("truth"), side(is_a, "_a"), side(is_b, "_b"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .select(row_id, "truth", F.col("_a.prob").alias("a_prob"), F.col("_a.why").alias("a_why"),
                F.col("_b.prob").alias("b_prob"), F.col("_b.why").alias("b_why"))
    )


def flip_report(flips: DataFrame, n: int = 12, row_id: str = "row_id") -> DataFrame:
    """The first ``n`` flips as text lines, each with the number of all flips."""
    total = flips.agg(F.count(F.lit(1)).alias("flips")).scalar()
    return flips.orderBy(row_id).limit(n).select(
        row_id, total.alias("flips"), state_line(F.col("truth")).alias("state"),
        F.concat(F.lit("p="), shown_number(F.col("a_prob")), F.lit(": "),
                 F.coalesce("a_why", F.lit("None"))).alias("first"),
        F.concat(F.lit("p="), shown_number(F.col("b_prob")), F.lit(": "),
                 F.coalesce("b_why", F.lit("None"))).alias("second"))


def side_by_side(
    completions: DataFrame, region: Column, variants: Sequence[str], tail: int = 220,
    row_id: str = "row_id",
) -> DataFrame:
    """One row per item: the facts, and per variant the parsed probability and the end of the answer
    on one line. A variant without an answer to an item has NULL."""
    last = F.when(F.length(region) > tail, F.right(region, F.lit(tail))).otherwise(region)
    answers = completions.select(
        row_id, "variant", "outcome", "target", "market",
        F.struct("prob", F.replace(last, F.lit("\n"), F.lit(" ")).alias("answer_tail")).alias("_a"))
    return answers.groupBy(row_id).agg(
        *[F.max(c).alias(c) for c in ("outcome", "target", "market")],
        *[F.max(F.when(F.col("variant") == v, F.col("_a"))).alias(v) for v in variants])


def tail_head_views(df: DataFrame, text: Column, n: int = 200) -> DataFrame:
    """First and last ``n`` characters, for inspection."""
    return df.withColumns({
        "head": F.left(text, F.lit(n)), "tail": F.right(text, F.lit(n)),
        "chars": F.length(text)})
