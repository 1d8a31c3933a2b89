"""Connected components of an edge table by hooking and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.tables import written


def _same(df: DataFrame) -> bool:
    return df.isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``edges`` (a, b bigint).

    A round hooks every root that has a smaller neighbour to the smallest one, shortens the paths
    that come of it to one step, and rewrites the edges between roots; edges inside a component
    vanish. Roots never point upwards, so there are no cycles. Hooks are minima with a map-side
    combine, so a node with many edges costs its tasks no more than any other.
    """
    links = _between(edges.select("a", "b"))
    links = written(links, "edges")
    nodes = links.select(F.col("high").alias("node")).union(links.select("low")).distinct()
    labels = None
    while not _same(links):
        hooks = written(links.groupBy("high").agg(F.min("low").alias("low")), "hooks")
        hooks = _shortened(hooks)
        moved = _follow(_follow(links, "high", hooks), "low", hooks).select(
            F.col("high").alias("a"), F.col("low").alias("b"))
        labels = nodes.withColumn("component", F.col("node")) if labels is None else labels
        labels = written(_follow(labels, "component", hooks), "labels")
        links = written(_between(moved), "edges")
    return labels if labels is not None else nodes.withColumn("component", F.col("node"))


def _between(pairs: DataFrame) -> DataFrame:
    """Distinct edges from a larger to a smaller node."""
    return pairs.filter("a != b").select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()


def _follow(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``column`` moved to what it is hooked to, if it is."""
    to = hooks.select(F.col("high").alias("_from"), F.col("low").alias("_to"))
    return df.join(to, F.col(column) == F.col("_from"), "left").withColumn(
        column, F.coalesce("_to", column)).drop("_from", "_to")


def _shortened(hooks: DataFrame) -> DataFrame:
    """Hooks that lead to a root in one step; every turn halves the paths."""
    while True:
        ends = hooks.select(F.col("high").alias("_at"))
        if _same(hooks.join(ends, F.col("low") == F.col("_at"), "left_semi")):
            return hooks
        hooks = written(_follow(hooks, "low", hooks), "hooks")
