"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of its documents and its blocks stand in a fixed random
order. A source that is to give ``target`` words gives every block ``epochs`` times and the first
blocks of the order once more; the block in which the target falls gives the documents that come
first in its own random order. Output shards then get exact quotas of those block draws: the tree
halves the range of shards, and at each node one multivariate-hypergeometric draw says how many of
each source's blocks go left. Leaves are disjoint, so the shards together hold every draw once. In
a shard the documents are sorted by a random key.

The tree has two parts. Sources are dealt to ``GROUPS`` groups by a hash; the driver splits the
draws of whole groups, and a task splits those of a group among its sources with the group's shares
of the shards as sizes. Drawing first for sums and then inside them is the same as drawing at once.
So the driver holds sums of groups only, however many sources there are, and a task the blocks of its
group. Targets come from a few sums over the table of sources.

Documents meet two small tables, one row per source and one per block, so a source with a third of
all rows is no heavier for any task than a small one. Up to ``FEW`` rows, which are counted, such a
table is broadcast; beyond, rows are spread by salts.

Defined results: NULL text has size 0; NULL sources form one source, last in order; repeated rows
have one key and are taken alike; rows of size 0 follow their block but take no words; an empty
table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.llm.tables import written
from calibrant.operators.joins import salted_join
from calibrant.operators.sampling import with_row_index

WORD = r"[^\x20\x09-\x0D]+"
GROUPS = 1024
FEW = 1 << 17
_SOURCE = ["missing", "name"]


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix. ``weights`` repeat over the sources in code point order."""

    weights: Sequence[float] = (1, 2, 3)
    most_epochs: int = 3          # a source gives at most this many times its size
    block_words: int = 100_000    # a block holds about this many words ...
    most_blocks: int = 65_536     # ... or more, where a source would have more blocks than this
    shard_words: int = 4_000_000  # a shard gets about this many words ...
    most_shards: int = 4_096      # ... or more, where there would be more shards than this
    most_sources: int | None = None  # more sources are an error, if set
    seed: int = 20


def with_targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``sources`` (with ``size`` and ``weight``) with ``target``: sum(size) shared by weight, no share
    above ``most`` times its size, the excess reshared."""
    size, weight = F.col("size"), F.col("weight")
    full, known, target = F.lit(False), -1, F.lit(0.0)
    while True:
        row = sources.where("size > 0").agg(
            F.count_if(full).alias("full"), F.sum("size").alias("size"),
            F.coalesce(F.sum(F.when(full, size)), F.lit(0)).alias("taken"),
            F.sum(F.when(~full, weight)).alias("weight")).first()
        # Shares only grow from pass to pass, so the full sources of one pass are full in the next.
        if row.full == known or row.weight is None:
            break
        known = row.full
        share = F.lit(float(row.size) - most * row.taken) * weight / F.lit(float(row.weight))
        full = share > most * size
        target = F.when(full, (most * size).cast("double")).otherwise(share)
    return sources.withColumn("target", F.when(size > 0, target).otherwise(0.0))


def leaves(
    units: np.ndarray, capacity: np.ndarray, seed: Sequence[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows, draws) of a splitting tree: ``units`` per row, ``capacity`` per shard, equal sums."""
    upto = np.concatenate([[0], np.cumsum(capacity, dtype=np.int64)])
    rows = np.flatnonzero(units)
    nodes = [(0, len(capacity), rows, np.asarray(units, dtype=np.int64)[rows])]
    while nodes:
        low, high, rows, here = nodes.pop()
        if high - low == 1:
            yield low, rows, here
            continue
        middle = (low + high) // 2
        draw = np.random.Generator(np.random.Philox([*seed, low, high]))
        left = draw.multivariate_hypergeometric(here, int(upto[middle] - upto[low]), method="marginals")
        for first, last, part in ((low, middle, left), (middle, high, here - left)):
            kept = part > 0
            if kept.any():
                nodes.append((first, last, rows[kept], part[kept]))


def split_quotas(units: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Block draws per row and shard: rows add up to ``units``, columns are equal within one."""
    quotas = np.zeros((len(units), shards), dtype=np.int64)
    capacity = np.diff(np.arange(shards + 1, dtype=np.int64) * int(sum(units)) // max(shards, 1))
    for shard, rows, draws_ in leaves(np.asarray(units, dtype=np.int64), capacity, [seed]):
        quotas[rows, shard] = draws_
    return quotas


def measured(docs: DataFrame, mix: Mix) -> DataFrame:
    """One slim row per document: its source, its size in words and its place in the random order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *_source(),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), _key(mix).alias("key"))


@dataclass
class Plan:
    """``sources``: blocks per source; ``blocks``: per block the copies that documents take of it."""

    sources: DataFrame
    blocks: DataFrame
    shards: int
    few_sources: bool
    few_blocks: bool


def plan_sources(slim: DataFrame, mix: Mix) -> Plan:
    """The plan of a mix."""
    totals = with_row_index(slim.groupBy(*_SOURCE).agg(F.sum("size").alias("size")), _SOURCE, name="place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("place") % len(mix.weights)).cast("int"))
    totals = written(totals.withColumn("weight", weight), "mix-sources")
    count, words = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if mix.most_sources is not None and count > mix.most_sources:
        raise ValueError(f"more than {mix.most_sources} sources; raise most_sources")
    few = count <= FEW
    size, target = F.col("size"), F.col("target")
    epochs = F.when(size > 0, F.least(F.lit(mix.most_epochs), F.floor(target / size + 1e-12))).otherwise(0)
    sources = written(
        with_targets(totals, mix.weights, mix.most_epochs)
        .withColumn("epochs", epochs.cast("int"))
        .withColumn("rest", F.greatest(F.lit(0.0), target - F.col("epochs") * size))
        .withColumn("blocks", F.greatest(F.lit(1), F.least(
            F.lit(mix.most_blocks), F.ceil(size / mix.block_words))).cast("int"))
        .select(*_SOURCE, F.col("size").alias("source_size"), "target", "epochs", "rest", "blocks"), "mix-targets")

    in_blocks = _meet(slim, sources, _SOURCE, few).withColumn("block", _block())
    sums = in_blocks.groupBy(*_SOURCE, "block").agg(
        F.sum("size").alias("words"),
        *[F.first(c).alias(c) for c in ("source_size", "target", "epochs", "rest")])
    # At most ``most_blocks`` rows of a source meet in one window.
    whole = Window.partitionBy(*_SOURCE)
    order = whole.orderBy(F.xxhash64("block", F.lit(mix.seed)), "block")
    fits = (F.col("rest") > 0) & (F.col("before") + F.col("words") <= F.col("rest"))
    ranked = written(
        sums.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("before", F.sum("words").over(order) - F.col("words"))
        .withColumn("used", F.count(F.lit(1)).over(whole))
        # A rest of nothing takes no block, not even one whose words are none.
        .withColumn("whole", F.sum(fits.cast("int")).over(whole)), "mix-blocks")
    # The one block of a source in which its target falls is cut by the order of its documents.
    cut = ranked.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    inner = Window.partitionBy(*_SOURCE).orderBy("key")
    # Same key, same row: such rows are taken or left together. A block has few documents with words.
    within = (
        _meet(in_blocks.filter("size > 0").select(*_SOURCE, "block", "size", "key"),
              cut.select(*_SOURCE, "block", "before", "rest"), [*_SOURCE, "block"], few)
        .groupBy(*_SOURCE, "key", "before", "rest").agg(F.sum("size").alias("words"))
        .withColumn("reach", F.col("before") + F.sum("words").over(inner) - F.col("words") / 2)
        .filter(F.col("reach") <= F.col("rest"))
        .groupBy(*_SOURCE).agg(F.max("key").alias("cut_key")))
    marked = ranked.join(within, _SOURCE, "left").withColumn(
        "extra", F.col("whole") + F.col("cut_key").isNotNull().cast("int"))
    reach = F.when(F.col("rank") < F.col("whole"), F.lit((1 << 63) - 1)).when(
        F.col("rank") == F.col("whole"), F.col("cut_key"))
    marked = written(marked.select(
        F.pmod(F.xxhash64(*_SOURCE, F.lit(mix.seed)), F.lit(GROUPS)).cast("int").alias("part"), *_SOURCE, "block",
        "rank", "used", "epochs", "extra", "source_size", "target", reach.alias("reach")), "mix-marks")
    shards = max(1, min(mix.most_shards, math.ceil(words / mix.shard_words)))
    blocks = written(_dealt(marked, shards, mix.seed), "mix-shards")
    return Plan(sources.select(*_SOURCE, "blocks"), blocks, shards, few, blocks.count() <= FEW)


def _dealt(marked: DataFrame, shards: int, seed: int) -> DataFrame:
    """Every block with the shards of its copies, drawn group by group."""
    spark = marked.sparkSession
    units = marked.groupBy("part").agg(F.sum(
        F.col("epochs") + (F.col("rank") < F.col("extra")).cast("int")).alias("units")).orderBy("part").collect()
    quotas = split_quotas([row.units for row in units], shards, seed)
    parts = pa.table([
        pa.array([row.part for row in units], pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1, dtype=np.int32) * shards), pa.array(quotas.reshape(-1))),
    ], names=["part", "capacity"])
    capacity = spark.createDataFrame(parts) if units else spark.createDataFrame([], "part int, capacity array<bigint>")

    def draw(blocks: pa.Table, sizes: pa.Table) -> pa.Table:
        blocks = blocks.sort_by([(c, "ascending") for c in (*_SOURCE, "rank")])
        rank, used, epochs, extra = (
            blocks.column(c).to_numpy().astype(np.int64) for c in ("rank", "used", "epochs", "extra"))
        # Ranks of a source run from 0 to used - 1, so a source begins where the rank is 0.
        source = np.cumsum(rank == 0) - 1
        each = (epochs * used + extra)[rank == 0]
        drawn = list(leaves(each, sizes.column("capacity")[0].values.to_numpy(),
                            [seed, 1 + blocks.column("part")[0].as_py()])) if each.sum() else []
        shard = np.concatenate([np.full(len(rows), at) for at, rows, _ in drawn] or [np.empty(0, np.int64)])
        owner = np.concatenate([rows for _, rows, _ in drawn] or [np.empty(0, np.int64)])
        counts = np.concatenate([n for _, _, n in drawn] or [np.empty(0, np.int64)])
        order = np.lexsort((shard, owner))
        ends = np.cumsum(counts[order])
        # Draws are numbered source by source; those of a source shard by shard.
        copies = epochs + (rank < extra)
        first = np.cumsum(copies) - copies
        copy = np.arange(copies.sum()) - np.repeat(first, copies)
        number = np.repeat((np.cumsum(each) - each)[source] + rank, copies) + copy * np.repeat(used, copies)
        found = shard[order][np.searchsorted(ends, number, side="right")].astype(np.int32)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(first, copies.sum()).astype(np.int32)), pa.array(found))
        return blocks.select([*_SOURCE, "block", "source_size", "target", "epochs", "reach"]).append_column(
            "shards", lists)

    return marked.groupBy("part").cogroup(capacity.groupBy("part")).applyInArrow(
        draw, "missing boolean, name string, block int, source_size bigint, target double, epochs int, "
        "reach bigint, shards array<int>")


def _meet(rows: DataFrame, lookup: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Inner join; ``few`` tells that ``lookup`` was counted and may be broadcast."""
    return rows.join(F.broadcast(lookup), keys) if few else salted_join(rows, lookup, keys, "inner", "key")


def draws(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` (with their source and ``key``) with source_size, target and ``shards`` (one per copy)."""
    placed = _meet(rows, plan.sources, _SOURCE, plan.few_sources).withColumn("block", _block())
    met = _meet(placed, plan.blocks, [*_SOURCE, "block"], plan.few_blocks)
    copies = F.col("epochs") + F.coalesce(F.col("key") <= F.col("reach"), F.lit(False)).cast("int")
    return met.withColumn("shards", F.slice("shards", F.lit(1), copies))


def mix_table(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words), shards (one per copy)."""
    slim = written(measured(docs, mix), "mix-sizes")
    return draws(slim, plan_sources(slim, mix)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document comes as often as it is taken. Shards are partitions; inside one the rows stand in
    random order.
    """
    plan = plan_sources(written(measured(docs, mix), "mix-sizes"), mix)
    rows = docs.select(F.struct("*").alias("document"), *_source(), _key(mix).alias("key"))
    taken = draws(rows, plan).select("document", "key", F.posexplode("shards").alias("copy", "shard"))
    order = F.xxhash64("key", "copy", "shard", F.lit(mix.seed))
    return (
        taken.repartitionById(plan.shards, F.col("shard"))
        .sortWithinPartitions("shard", order)
        .select("document.*"))


def _source() -> list[Column]:
    """A source as two columns that are never NULL; NULL comes last in their order."""
    source = F.col("source").cast("string")
    return [source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("name")]


def _key(mix: Mix):
    # xxhash64 passes over NULL, so a NULL text has the key of its id alone.
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(mix.seed))


def _block() -> Column:
    return F.pmod(F.col("key"), F.col("blocks")).cast("int")
