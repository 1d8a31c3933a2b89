"""The trie of rebuilt conversations, summed up by centroid decomposition.

**Rebuilding.** Turns are put in order by range partitions of (conv_id, turn, ...), so a conversation
of any length lies in several parts; its turns are numbered inside a part and moved on by the sizes of
its earlier parts. Texts stay where they are read: a turn goes on as two 64-bit hashes (together 128
bits) and its number of code points.

**Nodes.** A turn and its position hash to 128 bits; a prefix is the exclusive or of its turns' hashes,
which runs along the parts like the numbers do. Two of n prefixes are taken for one with odds of
n^2 / 2^129, 1e-17 for 10^11 turns. A node is named by (smallest member, depth). A conversation is
the smallest member of the nodes from some depth on to its end, so nodes are chains hanging on chains.

**Sums over subtrees.** The forest of parent edges is split at centroids. The mass of a node is the
number of turns that conversations have from it on; it comes with the grouping that makes the nodes.
Inside a component the nodes with at least half of its mass are one path down from its top, and the
lowest of them is the centroid, so no subtree has to be searched. What lies below the centroid is
totalled, the total is added to the nodes of the path from the centroid to the top, their masses go
down by the centroid's, and the component falls into the part above and one part per child of the
centroid, none with more than half of the mass. So rounds grow with the logarithm of the mass, however
deep the trie is. Which child of the centroid a node lies under is read from the table of members: the
node that its own conversation passes one step below the centroid. Components of at most ``whole``
turns are finished inside a task by the same rule, many at a time.

**Ends.** Ids of the conversations that end at a node are joined in blocks of consecutive ids; only
the blocks of a node meet to be hashed, streamed in order.

Defined results: turns without conv_id belong to no conversation. Equal turn numbers are ordered by
role, then by hash. NULL role and text are empty, repeated rows are turns of their own, other columns
are not read, an empty table has no nodes (not even a root). A conversation whose turns all fall away
is a member of the root and ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.llm.tables import shuffle_width, written

SUMS = "conv_id bigint, depth bigint, n_leaves bigint, saved bigint"
_KEY = ["conv_id", "depth"]
_TOP = ["top_conv", "top_depth"]
_BLOCK_BITS = 13


@dataclass(frozen=True)
class Rules:
    """How conversations are rebuilt, and the largest component that one task finishes."""

    family: int = 100
    heads: int = 6
    whole: int = 8192


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _placed(position: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at a position."""
    position = position.cast("bigint")
    return F.xxhash64(F.lit(3), position, first), F.xxhash64(F.lit(4), position, second)


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, rank (from 1), own (turns of the conversation), h1, h2, chars; written."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.char_length(text).cast("bigint").alias("chars"))
    order = ["turn", "role", "h1", "h2"]
    turns = written(
        turns.repartitionByRange(shuffle_width(turns.sparkSession), "conv_id", *order)
        .withColumn("part", F.spark_partition_id()), "turns")
    sizes = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    # A conversation has one row per part that it touches.
    conversation = Window.partitionBy("conv_id")
    sizes = sizes.select(
        "conv_id", "part", F.sum("n").over(conversation).alias("own"),
        (F.sum("n").over(conversation.orderBy("part")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return written(
        turns.withColumn("local", local).join(sizes, ["conv_id", "part"]).select(
            "conv_id", "part", (F.col("before") + F.col("local")).alias("rank"), "own", "h1", "h2",
            "chars"), "ranked")


def rebuild(ranked: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns, and conversations (conv_id, total).

    A rebuilt turn has conv_id, depth (from 1), total (turns of the rebuilt conversation), chars, the
    prefix it ends (f1, f2) and the one before it (p1, p2); written.
    """
    heads = ranked.where(
        (F.col("rank") < rules.heads) & (F.col("conv_id") % rules.family == 0)
    ).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "h1", "h2", "chars"))).alias("head"))
    number = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    facts = ranked.groupBy("conv_id").agg(F.max("own").alias("own")).select(
        "*", (number % rules.heads).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % rules.family).alias("base")
    ).join(heads, "base", "left")
    taken = F.filter(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)),
                     lambda turn: turn["rank"] <= F.col("h"))
    placed = F.transform(taken, lambda turn: F.struct(
        turn["rank"].alias("depth"), *[hash.alias(name) for name, hash in zip(
            ("r1", "r2"), _placed(turn["rank"], turn["h1"], turn["h2"]))], turn["chars"].alias("chars")))

    def joint(name: str) -> Column:
        return F.aggregate("taken", _zero(), lambda held, turn: held.bitwiseXOR(turn[name]))

    facts = facts.withColumn("taken", placed)
    facts = written(facts.select(
        "conv_id", "h", "taken", F.size("taken").cast("bigint").alias("n_head"),
        joint("r1").alias("b1"), joint("r2").alias("b2"),
        (F.size("taken") + F.greatest(F.col("own") - F.col("h"), _zero())).alias("total")), "rebuilt")

    first = facts.select("conv_id", "total", F.inline("taken"))
    along = Window.partitionBy("conv_id").orderBy("depth")  # fewer than ``heads`` rows
    first = first.select(
        "conv_id", "depth", "total", "chars", "r1", "r2",
        *[F.bit_xor(f"r{i}").over(along).alias(f"f{i}") for i in (1, 2)])

    touched = ranked.select("conv_id", "part").distinct().join(facts.drop("taken"), "conv_id")
    depth = F.col("rank") - F.col("h") + F.col("n_head")
    own = ranked.join(touched, ["conv_id", "part"]).where(F.col("rank") > F.col("h")).withColumn("depth", depth)
    own = own.withColumns(dict(zip(("r1", "r2"), _placed(F.col("depth"), F.col("h1"), F.col("h2")))))
    parts = own.groupBy("conv_id", "part").agg(*[F.bit_xor(f"r{i}").alias(f"x{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", *[
        F.coalesce(F.bit_xor(f"x{i}").over(earlier), _zero()).alias(f"e{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv_id", "part").orderBy("depth")
    own = own.withColumns({f"l{i}": F.bit_xor(f"r{i}").over(inside) for i in (1, 2)}).join(
        parts, ["conv_id", "part"]).select(
        "conv_id", "depth", "total", "chars", "r1", "r2",
        *[F.col(f"b{i}").bitwiseXOR(F.col(f"e{i}")).bitwiseXOR(F.col(f"l{i}")).alias(f"f{i}") for i in (1, 2)])
    turns = first.unionByName(own).select(
        "conv_id", "depth", "total", "chars", "f1", "f2",
        *[F.col(f"f{i}").bitwiseXOR(F.col(f"r{i}")).alias(f"p{i}") for i in (1, 2)])
    return written(turns, "rebuilt-turns"), facts.select("conv_id", "total")


def build_nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, saved (own), mass, f1, f2; written."""
    left = F.col("total") - F.col("depth") + 1
    nodes = turns.groupBy("depth", "f1", "f2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.sum(left).alias("mass"))
    root = conversations.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("total") + 1).alias("mass")).where("n_convs > 0").select(
        _zero().alias("depth"), _zero().alias("f1"), _zero().alias("f2"), "conv_id", "n_convs",
        _zero().alias("chars"), F.lit(None).cast("bigint").alias("p1"),
        F.lit(None).cast("bigint").alias("p2"), "mass")
    nodes = written(nodes.unionByName(root), "nodes")
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(parents, ["depth", "p1", "p2"], "left")
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    return written(linked.join(children, ["depth", "f1", "f2"], "left").select(
        *_KEY, "parent_conv_id", "n_convs", F.coalesce("n_children", _zero()).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), "mass", "f1", "f2"), "tree")


def memberships(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, depth, total, node_conv and parent_conv of the node a conversation passes; written."""
    names = nodes.select("depth", "f1", "f2", F.col("conv_id").alias("node_conv"),
                         F.col("parent_conv_id").alias("parent_conv"))
    return written(turns.select("conv_id", "depth", "total", "f1", "f2").join(
        names, ["depth", "f1", "f2"]).drop("f1", "f2"), "members")


def _root(nodes: DataFrame) -> Column:
    """The smallest member of the root, one number."""
    first = nodes.where("depth = 0").select("conv_id").first()
    return F.lit(first.conv_id if first else None).cast("bigint")


def subtree_sums(nodes: DataFrame, members: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """SUMS: childless nodes and saved characters in the subtree of every node."""
    state = written(nodes.select(
        *_KEY, F.col("parent_conv_id").alias("parent"), "mass",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaf"), "saved",
        _zero().alias("add_leaf"), _zero().alias("add_saved"),
        _root(nodes).alias("top_conv"), _zero().alias("top_depth")), "parts")
    done, small = [], []
    while True:
        sizes = written(state.groupBy(*_TOP).agg(F.max("mass").alias("whole")), "components")
        small.append(state.join(sizes.where(F.col("whole") <= rules.whole).drop("whole"), _TOP))
        sizes = sizes.where(F.col("whole") > rules.whole)
        if sizes.isEmpty():
            break
        state, finished = _split(state.join(sizes, _TOP), members)
        done.append(finished)
    rest = small[0]
    for part in small[1:]:
        rest = rest.unionByName(part)
    sums = rest.repartition(shuffle_width(rest.sparkSession), *_TOP).sortWithinPartitions(
        *_TOP).select(*_TOP, *_KEY, "parent", "mass", "leaf", "saved", "add_leaf", "add_saved").mapInArrow(
        _finish, SUMS)
    for part in done:
        sums = sums.unionByName(part)
    return sums


def _split(state: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: the components after taking out their centroids (written), and the centroids' sums."""
    on_path = F.col("mass") * 2 >= F.col("whole")
    centroids = written(state.where(on_path).groupBy(*_TOP).agg(
        F.max("depth").alias("c_depth"), F.max_by("conv_id", "depth").alias("c_conv"),
        F.max_by("mass", "depth").alias("c_mass")), "centroids")
    state = state.join(centroids, _TOP).withColumn(
        "path", on_path).withColumn("c", on_path & (F.col("depth") == F.col("c_depth")))
    maybe = ~F.col("path") & (F.col("depth") > F.col("c_depth"))
    # The node one step below the centroid's depth that a node's own conversation passes.
    wanted = state.where(maybe).select("conv_id", "c_depth", "c_conv").distinct()
    below = members.select(
        "conv_id", (F.col("depth") - 1).alias("c_depth"), F.col("parent_conv").alias("c_conv"),
        F.col("node_conv").alias("child"))
    found = wanted.join(below, ["conv_id", "c_depth", "c_conv"]).select(
        F.col("conv_id").alias("of_conv"), F.col("c_depth").alias("of_depth"),
        F.col("c_conv").alias("of_c"), "child")
    state = written(state.join(
        found, (F.col("conv_id") == F.col("of_conv")) & (F.col("c_depth") == F.col("of_depth"))
        & (F.col("c_conv") == F.col("of_c")) & maybe, "left").drop("of_conv", "of_depth", "of_c"), "round")
    under = F.col("c") | F.col("child").isNotNull()
    totals = written(state.where(under).groupBy(*_TOP).agg(
        F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved")), "totals")
    state = state.join(totals, _TOP)
    finished = state.where("c").select(
        *_KEY, (F.col("add_leaf") + F.col("t_leaf")).alias("n_leaves"),
        (F.col("add_saved") + F.col("t_saved")).alias("saved"))
    lower = F.col("child").isNotNull()
    moved = state.where(~F.col("c")).select(
        *_KEY, "parent",
        F.when(F.col("path"), F.col("mass") - F.col("c_mass")).otherwise(F.col("mass")).alias("mass"),
        "leaf", "saved",
        F.when(F.col("path"), F.col("add_leaf") + F.col("t_leaf")).otherwise(F.col("add_leaf")).alias("add_leaf"),
        F.when(F.col("path"), F.col("add_saved") + F.col("t_saved")).otherwise(F.col("add_saved")).alias("add_saved"),
        F.when(lower, F.col("child")).otherwise(F.col("top_conv")).alias("top_conv"),
        F.when(lower, F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"))
    return written(moved, "parts"), finished


def _finish(batches: Iterator[pa.RecordBatch], most_rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Whole components, which come one after the other, some at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(np.column_stack([
            column.fill_null(-1).to_numpy(zero_copy_only=False) for column in batch.columns]).astype(np.int64))
        rows += batch.num_rows
        if rows < most_rows:
            continue
        data = np.concatenate(held)
        same = (data[:, :2] == data[-1, :2]).all(axis=1)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield _sums(data[:cut])
        held, rows = [data[cut:]], len(data) - cut
    data = np.concatenate(held) if held else np.empty((0, 10), np.int64)
    if len(data):
        yield _sums(data)


def _sums(data: np.ndarray) -> pa.RecordBatch:
    conv, depth, parent = data[:, 2], data[:, 3], data[:, 4]
    component = np.unique(data[:, :2], axis=0, return_inverse=True)[1].ravel()
    result = decompose(component, conv, depth, parent, data[:, 5], data[:, 6:8], data[:, 8:10])
    return pa.RecordBatch.from_arrays(
        [pa.array(conv), pa.array(depth), pa.array(result[:, 0]), pa.array(result[:, 1])],
        names=["conv_id", "depth", "n_leaves", "saved"])


def decompose(
    component: np.ndarray, conv: np.ndarray, depth: np.ndarray, parent: np.ndarray, mass: np.ndarray,
    own: np.ndarray, added: np.ndarray,
) -> np.ndarray:
    """Sums of ``own`` over subtrees plus what was ``added`` before, for many components at once.

    A node is (conv, depth), its parent (parent, depth - 1) where that is in the same component.
    """
    n = len(conv)
    up = _parents(component, conv, depth, parent)
    begin, size = _intervals(up, depth)
    by_place = np.lexsort((begin, depth))
    place = depth[by_place] * (n + 1) + begin[by_place]
    tops = np.flatnonzero(up < 0)
    top_of = np.empty(int(component.max()) + 1, np.int64)
    top_of[component[tops]] = tops
    part = top_of[component]               # a component is named by its top
    mass, result = mass.copy(), added.copy()
    alive = np.arange(n)
    lowest, centre, total = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros_like(own)
    while len(alive):
        top = part[alive]
        path = 2 * mass[alive] >= mass[top]
        lowest[top] = -1
        np.maximum.at(lowest, top[path], depth[alive][path])
        centroid = path & (depth[alive] == lowest[top])
        centre[top[centroid]] = alive[centroid]
        c = centre[top]
        under = (begin[alive] >= begin[c]) & (begin[alive] < begin[c] + size[c])
        total[top] = 0
        np.add.at(total, top[under], own[alive][under])
        gains = path & ~under | centroid
        result[alive[gains]] += total[top[gains]]
        above = path & ~centroid
        loss = mass[c]
        mass[alive[above]] -= loss[above]
        moves = under & ~centroid
        inner, outer = alive[moves], c[moves]
        child = by_place[np.searchsorted(place, (depth[outer] + 1) * (n + 1) + begin[inner], side="right") - 1]
        part[inner] = child
        alive = alive[~centroid]
    return result


def _parents(component, conv, depth, parent) -> np.ndarray:
    """The row of each node's parent, -1 for the tops of components."""
    names, code = np.unique(np.concatenate([conv, parent]), return_inverse=True)
    width = int(depth.max()) + 2
    key = code[:len(conv)] * width + depth + 1
    order = np.argsort(key)
    wanted = code[len(conv):] * width + depth
    at = np.searchsorted(key[order], wanted)
    at[at == len(order)] = 0
    row = order[at]
    return np.where((key[row] == wanted) & (component[row] == component) & (depth > 0), row, -1)


def _intervals(up: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of nodes of every subtree in an order that visits parents first."""
    order = np.argsort(depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[order])) + 1
    levels = np.split(order, ends)
    size = np.ones(len(up), np.int64)
    for level in reversed(levels):
        inner = level[up[level] >= 0]
        np.add.at(size, up[inner], size[inner])
    begin = np.empty(len(up), np.int64)
    tops = np.flatnonzero(up < 0)
    begin[tops] = np.cumsum(size[tops]) - size[tops]
    for level in levels:
        inner = level[up[level] >= 0]
        inner = inner[np.argsort(up[inner], kind="stable")]
        before = np.cumsum(size[inner]) - size[inner]
        first = np.concatenate([[True], np.diff(up[inner]) != 0])[:len(inner)]
        base = np.maximum.accumulate(np.where(first, before, 0)) if len(inner) else before
        begin[inner] = begin[up[inner]] + 1 + before - base
    return begin, size


def end_digests(members: DataFrame, conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes where conversations end."""
    ends = members.where("depth = total").select("conv_id", "depth", "node_conv").unionByName(
        conversations.where("total = 0").select(
            "conv_id", _zero().alias("depth"), _root(nodes).alias("node_conv")))
    # A block has at most 2^13 ids, because a conversation ends once.
    blocks = ends.groupBy("node_conv", "depth", F.shiftright("conv_id", _BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lines = blocks.select(
        "node_conv", "depth", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("line"))
    return lines.repartition(shuffle_width(lines.sparkSession), "node_conv", "depth").sortWithinPartitions(
        "node_conv", "depth", "block").mapInArrow(_digests, "conv_id bigint, depth bigint, ends_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, state = None, None

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.string())], names=["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        found = []
        for conv, depth, line in zip(*(batch.column(c).to_pylist() for c in ("node_conv", "depth", "line"))):
            if (conv, depth) == held:
                state.update(b"," + line.encode())
                continue
            if held is not None:
                found.append((*held, state.hexdigest()))
            held, state = (conv, depth), hashlib.sha256(line.encode())
        yield out(found)
    if held is not None:
        yield out([(*held, state.hexdigest())])


def trie_table(conversations: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    turns, conversations = rebuild(number_turns(conversations), rules)
    nodes = build_nodes(turns, conversations)
    members = memberships(turns, nodes)
    sums = subtree_sums(nodes, members, rules).withColumnRenamed("saved", "saved_tokens")
    ends = end_digests(members, conversations, nodes)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select(*_KEY, "parent_conv_id", "n_convs", "n_children").join(sums, _KEY).join(
        ends, _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
