"""State-conditioned empirical rates with shrinkage toward the coarser state.

A table has one row per key prefix: level 0 is the overall rate, level L conditions on the first L
keys. Each rate is shrunk toward the rate of its parent prefix with ``m`` pseudo-observations. A
state is looked up at the deepest prefix the table has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions.numbers import round_half_even
from calibrant.functions.parsing import (
    FIELD_EDGES, SCORE_EDGES, SPREAD_EDGES, TIME_EDGES, edge_bin,
)
from calibrant.session import stored

PSEUDO_COUNT = 25.0
#: Rate tables of up to so many rows are broadcast, each some tens of bytes.
BROADCAST_ROWS = 1 << 18


@dataclass(frozen=True)
class RateKey:
    """One key of the state, most important first."""

    name: str
    column: Column


def binned_key(name: str, column: Column, edges: Sequence[float]) -> RateKey:
    return RateKey(name, edge_bin(column, edges))


def state_keys(score: Column, seconds: Column, spread: Column,
               yards_to_goal: Column | None = None, down: Column | None = None) -> list[RateKey]:
    """Score, time and spread; with field position and down for the fine table.

    A down that is not one digit is unknown.
    """
    keys = [
        binned_key("score_bin", score, SCORE_EDGES),
        binned_key("time_bin", seconds, TIME_EDGES),
        binned_key("spread_bin", spread, SPREAD_EDGES),
    ]
    if yards_to_goal is not None:
        keys.append(binned_key("field_bin", yards_to_goal, FIELD_EDGES))
    if down is not None:
        keys.append(RateKey("down_bin", F.when(down.between(0, 9), down).cast("int")))
    return keys


def _finest_cells(df: DataFrame, keys: Sequence[RateKey], outcome: str) -> DataFrame:
    known = df.where(F.col(outcome).isNotNull())
    return known.groupBy(*[key.column.alias(key.name) for key in keys]).agg(
        F.sum(F.col(outcome).cast("bigint")).alias("wins"), F.count(F.lit(1)).alias("n"))


def rate_counts(df: DataFrame, keys: Sequence[RateKey], outcome: str = "outcome") -> DataFrame:
    """Wins and rows at every key prefix.

    The rows are reduced to the finest cells first; only the cells are rolled up.
    """
    names = [key.name for key in keys]
    cells = _finest_cells(df, keys, outcome)
    # grouping_id sets one bit per key that a prefix leaves out.
    left_out = F.length(F.regexp_replace(F.bin(F.grouping_id()), "0", ""))
    return cells.rollup(*names).agg(
        (F.lit(len(names)) - left_out).cast("int").alias("level"),
        F.sum("wins").alias("wins"), F.sum("n").alias("n"))


def rate_table(
    df: DataFrame, keys: Sequence[RateKey], outcome: str = "outcome", m: float = PSEUDO_COUNT
) -> DataFrame:
    """``(level, keys..., wins, n, phat)``; fit it on training rows. An action.

    The rows are read once: their counts at every prefix are stored, and each level takes its
    parent's rates by a join on the prefix. Adaptive execution broadcasts a level where it is small.
    """
    names = [key.name for key in keys]
    counts = stored(rate_counts(df, keys, outcome), "rate-counts")
    level = counts.where(F.col("level") == 0).withColumn("phat", F.col("wins") / F.col("n"))
    levels = [level]
    for depth in range(1, len(names) + 1):
        child = counts.where(F.col("level") == depth)
        parent = level.select(
            (F.col("level") + 1).alias("_child"), *names[:depth - 1], F.col("phat").alias("_parent"))
        same = reduce(and_, [child[n].eqNullSafe(parent[n]) for n in names[:depth - 1]],
                      child["level"] == parent["_child"])
        matched = child.join(parent, same).select(child["*"], "_parent")
        shrunk = (F.col("wins") + m * F.col("_parent")) / (F.col("n") + m)
        level = matched.withColumn("phat", shrunk).drop("_parent")
        levels.append(level)
    table = reduce(DataFrame.unionByName, levels).select("level", *names, "wins", "n", "phat")
    return stored(table, "rates")


def coarser(table: DataFrame, keys: Sequence[RateKey]) -> DataFrame:
    """The table over a prefix of the keys: its rates depend on no deeper level."""
    names = [key.name for key in keys]
    return table.where(F.col("level") <= len(names)).select("level", *names, "wins", "n", "phat")


@dataclass(frozen=True)
class Target:
    """One look-up: the column it adds, the rate table and the keys of a row."""

    name: str
    table: DataFrame
    keys: Sequence[RateKey]


def backoff_lookup(
    df: DataFrame, table: DataFrame, keys: Sequence[RateKey], name: str = "phat",
    decimals: int | None = None,
) -> DataFrame:
    """Add the rate of the deepest prefix in ``table`` and that prefix's level."""
    return longest_prefixes(df, [Target(name, table, keys)], decimals)


def longest_prefixes(
    df: DataFrame, targets: Sequence[Target], decimals: int | None = None,
    most_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """For every target, the rate of the deepest prefix its table has and that prefix's level.

    In keys NULL meets NULL and 0.0 meets -0.0. Tables of binned keys have at most as many rows as
    there are combinations of bins; if all have at most ``most_rows`` (they are counted), they are
    broadcast level by level and meet the rows as they are scanned: one scan and no shuffle for any
    number of targets. Otherwise the prefixes of all tables are one table of (target, level, key),
    met once by the prefixes of the distinct states; the deepest match of a state and target is an
    aggregate with a map-side combine, and the rows take their state's answers in one join.
    """
    targets = list(targets)
    overall = [t.table.where(F.col("level") == 0).select(_shown(decimals)).scalar() for t in targets]
    # States get names of their own, so the rows keep a column that is called like a key.
    states = [[f"_state{t}_{i}" for i in range(len(target.keys))] for t, target in enumerate(targets)]
    rows = df.withColumns({
        s: key.column for names, target in zip(states, targets) for s, key in zip(names, target.keys)})
    if all(target.table.count() <= most_rows for target in targets):
        rows = _met_levels(rows, targets, states, decimals)
    else:
        rows = _met_prefixes(rows, targets, states, decimals)
    added = {}
    for t, target in enumerate(targets):
        added[target.name] = F.coalesce(F.col(f"_rate{t}"), overall[t])
        added[f"{target.name}_level"] = F.coalesce(F.col(f"_depth{t}"), F.lit(0))
    return rows.withColumns(added).drop(
        *[s for names in states for s in names],
        *[c for t in range(len(targets)) for c in (f"_rate{t}", f"_depth{t}")])


def _shown(decimals: int | None) -> Column:
    return F.col("phat") if decimals is None else round_half_even(F.col("phat"), decimals)


def _met_levels(
    rows: DataFrame, targets: Sequence[Target], states: Sequence[Sequence[str]], decimals: int | None,
) -> DataFrame:
    """Every level of every table broadcast to the rows."""
    for t, target in enumerate(targets):
        found, depths = [], []
        for depth in range(len(target.keys), 0, -1):
            theirs, rate = [f"_key{t}_{depth}_{i}" for i in range(depth)], f"_rate{t}_{depth}"
            level = target.table.where(F.col("level") == depth).select(
                *[F.col(target.keys[i].name).alias(k) for i, k in enumerate(theirs)],
                _shown(decimals).alias(rate))
            same = [F.col(s).eqNullSafe(F.col(k)) for s, k in zip(states[t], theirs)]
            rows = rows.join(F.broadcast(level), reduce(and_, same), "left").drop(*theirs)
            found.append(F.col(rate))
            depths.append(F.when(F.col(rate).isNotNull(), depth))
        nothing = F.lit(None)
        rows = rows.withColumns({
            f"_rate{t}": F.coalesce(*found, nothing.cast("double")),
            f"_depth{t}": F.coalesce(*depths, nothing.cast("int")),
        }).drop(*[f"_rate{t}_{depth}" for depth in range(1, len(target.keys) + 1)])
    return rows


def _prefix(values: Sequence[Column]) -> Column:
    """Typed values as one text; different values never give the same."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def _plain(value: Column, kind: str) -> Column:
    """Both zeros of a floating type as one."""
    return value + F.lit(0).cast(kind) if kind in ("double", "float") else value


def _met_prefixes(
    rows: DataFrame, targets: Sequence[Target], states: Sequence[Sequence[str]], decimals: int | None,
) -> DataFrame:
    """The prefixes of the distinct states joined once with those of all tables."""
    entries, wanted = [], []
    for t, target in enumerate(targets):
        kinds = dict(target.table.dtypes)
        names = [key.name for key in target.keys]
        for depth in range(1, len(names) + 1):
            entries.append(target.table.where(F.col("level") == depth).select(
                F.lit(t).alias("_target"), F.lit(depth).alias("_level"),
                _prefix([_plain(F.col(n), kinds[n]) for n in names[:depth]]).alias("_prefix"),
                _shown(decimals).alias("_found")))
            wanted.append(F.struct(
                F.lit(t).alias("_target"), F.lit(depth).alias("_level"),
                _prefix([_plain(F.col(s).cast(kinds[n]), kinds[n])
                         for s, n in zip(states[t], names[:depth])]).alias("_prefix")))
    flat = [s for names in states for s in names]
    if not flat:
        nothing = F.lit(None)
        return rows.withColumns({c: nothing.cast(kind) for t in range(len(targets))
                                 for c, kind in ((f"_rate{t}", "double"), (f"_depth{t}", "int"))})
    distinct = rows.select(*flat).distinct()
    met = distinct.select("*", F.inline(F.array(*wanted))).join(
        reduce(DataFrame.unionByName, entries), ["_target", "_level", "_prefix"])
    best = []
    for t in range(len(targets)):
        mine = F.col("_target") == t
        best += [F.max_by("_found", F.when(mine, F.col("_level"))).alias(f"_rate{t}"),
                 F.max(F.when(mine, F.col("_level"))).alias(f"_depth{t}")]
    answers = met.groupBy(*flat).agg(*best).withColumnsRenamed({s: f"_at{s}" for s in flat})
    same = [F.col(s).eqNullSafe(F.col(f"_at{s}")) for s in flat]
    return rows.join(answers, reduce(and_, same), "left").drop(*[f"_at{s}" for s in flat])
