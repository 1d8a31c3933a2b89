"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors of length one are centred, projected on their principal axes and turned by a rotation that
is learnt to make the signs of the components a balanced binary code with little loss: the rotation
and the codes are improved in turn. It is learnt on a bounded sample (``sample``); every vector
gets a code.

Links join vectors with one label and a cosine of at least ``least``. Their codes differ in few
bits. A code is cut into ``tables`` parts; two vectors meet where a part differs in one bit at
most, which is sure to happen up to 2 * tables - 1 differing bits and very likely for some more. To
meet, a part is entered once for each of its bits with that bit left out. A pair meets in several
places and is judged in one: the first table in which it meets, at the bit that differs, or at the
first bit if none does. So links can be counted where they are found, and no pair leaves a task.

How far the codes of two linked vectors differ depends on the data: vectors with a common direction
lie close together and their codes split what is left. So the search is fitted on the sample, on
pairs moved to a cosine of exactly ``least``: as many codes with rotations of their own are taken,
each with its parts, as meet ``recall`` of these pairs, and ``radius`` grows to the bits in which
they differ. Where ``most_codes`` do not reach it, every pair of a label is judged.

First only codes are dealt out, and members without a partner within ``radius`` bits go; then those
left bring their original vectors, and cosines are computed in double precision. Equal vectors are
one node from the start and are counted by their number. Groups above ``block`` members are dealt
out as pairs of blocks.

Vectors of different lengths link with nothing of the other's; every length has a search of its own.
Labels of any type are compared as they are. Rows whose vector is NULL, zero, or holds NULL or no
finite number, and rows with a NULL label, link with nothing. Rows of one id are vectors of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.columns import mix
from calibrant.llm.components import connected
from calibrant.llm.tables import shuffle_width, written
from calibrant.llm.vectors import column_matrix, lengths, sample, unit, usable


@dataclass(frozen=True)
class Quantisation:
    """Parameters of the codes and the search."""

    least: float = 0.98
    bits: int = 64
    tables: int = 4
    radius: int = 20
    sample: int = 20_000
    rounds: int = 40
    block: int = 4096
    seed: int = 6
    recall: float = 0.99
    most_codes: int = 12
    pairs: int = 2000


@dataclass(frozen=True)
class Coder:
    center: np.ndarray
    turn: np.ndarray

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as unsigned 64-bit integers."""
        signs = (unit(vectors) - self.center) @ self.turn > 0
        packed = np.packbits(signs, axis=1, bitorder="little")
        padded = np.zeros((len(vectors), 8), dtype=np.uint8)
        padded[:, :packed.shape[1]] = packed
        return padded.view("<u8")[:, 0]


def learn(points: np.ndarray, settings: Quantisation) -> Coder:
    """Principal axes, then rotation and codes in turn."""
    points = unit(points)
    center = points.mean(axis=0)
    centred = points - center
    bits = min(settings.bits, points.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    projected = centred @ axes
    draw = np.random.default_rng(settings.seed)
    rotation, _ = np.linalg.qr(draw.normal(size=(bits, bits)))
    for _ in range(settings.rounds):
        codes = np.where(projected @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ projected)
        rotation = (left @ right).T
    return Coder(center, axes @ rotation)


def part_bits(bits: int, tables: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each part of a code."""
    cuts = [bits * t // tables for t in range(tables + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


@dataclass(frozen=True)
class Search:
    """Codes, their parts (bits of the second code are counted from 64 on) and the bits that may
    differ; ``recall`` is the share of fitted pairs that this meets."""

    coders: list[Coder]
    parts: list[tuple[int, int]]
    radius: int
    recall: float

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One row of codes per coder."""
        return np.array([coder.codes(vectors) for coder in self.coders])


def moved_pairs(points: np.ndarray, settings: Quantisation) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sampled vectors and others at a cosine of ``least``: towards other vectors, and anywhere."""
    draw = np.random.default_rng(settings.seed)
    points = unit(points)
    one = points[draw.integers(0, len(points), settings.pairs)]
    noise = draw.normal(size=one.shape)
    out = []
    for aim in (points[draw.integers(0, len(points), settings.pairs)] + 1e-6 * noise, noise):
        aim = aim - (aim * one).sum(axis=1, keepdims=True) * one
        length = np.sqrt((aim * aim).sum(axis=1, keepdims=True))
        aim = np.divide(aim, length, out=np.zeros_like(aim), where=length > 0)
        out.append((one, settings.least * one + np.sqrt(1 - settings.least ** 2) * aim))
    return out


def fit(points: np.ndarray, settings: Quantisation) -> Search:
    """As few codes as meet the recall; else one place in which all pairs meet."""
    pairs = moved_pairs(points, settings)
    bits = min(settings.bits, points.shape[1])
    coders, parts = [], []
    met = [np.zeros(settings.pairs, dtype=bool) for _ in pairs]
    differ = [np.zeros(settings.pairs, dtype=np.int64) for _ in pairs]
    for k in range(settings.most_codes):
        coders.append(learn(points, replace(settings, seed=settings.seed + k)))
        own = part_bits(bits, settings.tables)
        parts += [(64 * k + first, width) for first, width in own]
        for i, (one, two) in enumerate(pairs):
            bits_apart = coders[-1].codes(one) ^ coders[-1].codes(two)
            differ[i] += np.bitwise_count(bits_apart)
            for first, width in own:
                met[i] |= np.bitwise_count(_part(bits_apart, first, width)) <= 1
        recall = float(min(m.mean() for m in met))
        if recall >= settings.recall:
            radius = max(settings.radius * (k + 1), *(int(d.max()) for d in differ))
            return Search(coders, parts, radius, recall)
    return Search(coders[:1] or [learn(points, settings)], [(0, 0)], 64, 1.0)


def _part(codes: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits of a part; codes have a row per coder, or are of one coder."""
    return (np.atleast_2d(codes)[first // 64] >> np.uint64(first % 64)) & np.uint64((1 << width) - 1)


def _places(codes: np.ndarray, parts: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(table, bit left out, what is left of the part) for every place of every code."""
    for table, (first, width) in enumerate(parts):
        part = _part(codes, first, width)
        for bit in range(max(width, 1)):
            yield table, bit, part & np.uint64(~(1 << bit) & ((1 << width) - 1))


def _judged_here(
    differ: np.ndarray, parts: list[tuple[int, int]], table: int, bit: int
) -> np.ndarray:
    """Whether pairs whose codes differ in the bits ``differ`` are judged at this place."""
    here = np.ones(differ.shape[-1], dtype=bool)
    for t, (first, width) in enumerate(parts[:table + 1]):
        part = _part(differ, first, width)
        if t < table:
            here &= np.bitwise_count(part) > 1
        else:
            here &= (part == np.uint64(1 << bit)) | ((part == 0) & (bit == 0))
    return here


def _names(codes: int) -> list[str]:
    return [f"code{i}" for i in range(codes)]


def _codes(group: pa.Table, codes: int) -> np.ndarray:
    return np.array([group.column(name).to_numpy().view(np.uint64) for name in _names(codes)])


def _members(nodes: DataFrame, parts: list[tuple[int, int]], n: int) -> DataFrame:
    """key, node, codes, place for every place of every node (columns node, label, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, code = batch.column(0), batch.columns[2:]
            codes = np.array([c.to_numpy().view(np.uint64) for c in code])
            label = batch.column(1).to_numpy().view(np.uint64)
            for table, bit, rest in _places(codes, parts):
                place = table * 64 + bit
                key = mix(mix(mix(label) + rest) + np.uint64(place))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), node, *code,
                     pa.array(np.full(len(node), place, dtype=np.int32))],
                    names=["key", "node", *_names(n), "place"])

    kinds = "".join(f"{name} bigint, " for name in _names(n))
    return nodes.select("node", "label", *_names(n)).mapInArrow(
        run, f"key bigint, node bigint, {kinds}place int")


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Members of places with two or more, as pairs of blocks: adds pair, mine, cross."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")
    return (
        members.join(sizes, "key").withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("pair", F.xxhash64(
            "key", F.least("mine", "other"), F.greatest("mine", "other")))
        .withColumn("cross", F.col("mine") != F.col("other"))
        .drop("parts", "other"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal ``pair`` (the first column) of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        pairs = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(pairs)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(pairs)]):
            if end == begin:
                continue
            if held and held[0].column(0)[0].as_py() != int(pairs[begin]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _gather(dealt: DataFrame, columns: list[str]) -> DataFrame:
    return dealt.select("pair", *columns).repartition(
        shuffle_width(dealt.sparkSession), "pair").sortWithinPartitions("pair", "node")


def _pairs(
    codes: np.ndarray, mine: np.ndarray, cross: bool, parts: list[tuple[int, int]], place: int,
    radius: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members within ``radius`` bits that are judged at this place, row by row blocks."""
    table, bit = divmod(place, 64)
    size = codes.shape[1]
    for begin in range(0, size, 512):
        rows = np.arange(begin, min(begin + 512, size))
        apart = np.bitwise_count(codes[0, rows, None] ^ codes[0, None, :])
        for more in codes[1:]:
            apart = apart + np.bitwise_count(more[rows, None] ^ more[None, :]).astype(np.uint16)
        near = apart <= radius
        near &= rows[:, None] < np.arange(size)[None, :]
        if cross:
            near &= mine[rows, None] != mine[None, :]
        one, two = np.nonzero(near)
        if len(one):
            kept = _judged_here(codes[:, rows[one]] ^ codes[:, two], parts, table, bit)
            yield rows[one[kept]], two[kept]


def link_vectors(
    df: DataFrame, settings: Quantisation = Quantisation(), id_column: str = "vec_id",
    vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = df.select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("v"),
        F.when(F.col(label).isNotNull(), F.xxhash64(label)).alias("label"))
    rows = rows.withColumn("fit", usable("v") & F.col("label").isNotNull())
    rows = rows.withColumn("node", F.when(F.col("fit"), F.xxhash64("label", "v")))
    alone, fitting = rows.select("vec_id", "node"), rows.filter("fit")
    told = [_linked(fitting.filter(F.size("v") == size), size, settings) for size in lengths(fitting, "v")]
    if not told:
        return alone.select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"))
    return alone.join(functools.reduce(DataFrame.unionByName, told), "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


def _linked(rows: DataFrame, size: int, settings: Quantisation) -> DataFrame:
    """node, n_links, component_id of the distinct vectors of one length."""
    groups = rows.groupBy("node").agg(
        F.first("v").alias("v"), F.first("label").alias("label"), F.min("vec_id").alias("lowest"),
        F.count(F.lit(1)).alias("copies"))
    search = fit(sample(rows, "vec_id", "v", size, settings.sample, settings.seed), settings)
    parts, n_codes = search.parts, len(search.coders)
    names = _names(n_codes)
    code_kinds = ", ".join(f"{name} bigint" for name in names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = column_matrix(batch.column(1), size)
            codes = search.codes(vectors) if len(vectors) else np.empty((n_codes, 0), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in vectors], pa.binary()),
                 *(batch.column(i) for i in (2, 3, 4)),
                 *(pa.array(code.view(np.int64)) for code in codes)],
                names=["node", "v", "label", "lowest", "copies", *names])

    nodes = written(groups.select("node", "v", "label", "lowest", "copies").mapInArrow(
        encode,
        f"node bigint, v binary, label bigint, lowest bigint, copies bigint, {code_kinds}"), "codes")

    radius, least = search.radius, settings.least

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            code = _codes(group, n_codes)
            mine, cross = group.column("mine").to_numpy(), group.column("cross")[0].as_py()
            place = group.column("place")[0].as_py()
            seen = np.zeros(group.num_rows, dtype=bool)
            for one, two in _pairs(code, mine, cross, parts, place, radius):
                seen[one] = seen[two] = True
            if seen.any():
                yield from group.filter(pa.array(seen)).combine_chunks().to_batches()

    slim = ["node", *names, "place", "mine", "cross"]
    kinds = f"pair bigint, node bigint, {code_kinds}, place int, mine int, cross boolean"
    close = _gather(_dealt(_members(nodes, parts, n_codes), settings.block), slim).mapInArrow(partners, kinds)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            code = _codes(group, n_codes)
            mine, cross = group.column("mine").to_numpy(), group.column("cross")[0].as_py()
            place, node = group.column("place")[0].as_py(), group.column("node").to_numpy()
            copies = group.column("copies").to_numpy()
            vectors = unit(np.frombuffer(
                b"".join(group.column("v").to_pylist()), dtype="<f8").reshape(-1, size))
            found, root = np.zeros(len(node), np.int64), list(range(len(node)))
            edges = []
            for one, two in _pairs(code, mine, cross, parts, place, radius):
                for a in range(0, len(one), 8192):
                    x, y = one[a:a + 8192], two[a:a + 8192]
                    linked = (vectors[x] * vectors[y]).sum(axis=1) >= least
                    x, y = x[linked], y[linked]
                    np.add.at(found, x, copies[y])
                    np.add.at(found, y, copies[x])
                    edges += _joined(root, x, y)
            some = np.flatnonzero(found)
            one, two = (np.array([e[i] for e in edges], dtype=np.int64) for i in (0, 1))
            n = len(edges)
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node[some], node[one]])),
                     pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[two])]),
                     pa.array(np.concatenate([found[some], np.zeros(n, np.int64)]))],
                    names=["a", "b", "n"])

    judged = written(
        _gather(close.join(nodes.select("node", "v", "copies"), "node"),
                [*slim, "v", "copies"]).mapInArrow(links, "a bigint, b bigint, n bigint"), "links")
    counts = judged.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    placed = (
        nodes.select("node", "lowest", "copies")
        .join(connected(judged.filter("b is not null")), "node", "left")
        .join(counts, F.col("node") == F.col("a"), "left")
        .select("node", "lowest", F.coalesce("component", "node").alias("component"),
                (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    lowest = placed.groupBy("component").agg(F.min("lowest").alias("component_id"))
    return placed.join(lowest, "component").select("node", "n_links", "component_id")


def _joined(root: list[int], one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join two trees of the forest ``root``, which is updated."""
    out = []
    for a, b in zip(one.tolist(), two.tolist()):
        x, y = _root(root, a), _root(root, b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _root(root: list[int], a: int) -> int:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    return a
