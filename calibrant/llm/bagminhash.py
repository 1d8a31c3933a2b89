"""Near-duplicate documents by BagMinHash signatures over word shingles.

A document is the multiset of its runs of ``width`` words (ASCII letters in lower case); similarity
is weighted Jaccard: the sum of the smaller counts over the sum of the larger ones. A shorter text
is one shingle. Texts without words have no shingles and are like nothing.

Signature. Every shingle carries Poisson processes over its weight axis, cut into the intervals
[0, 1), [1, 2), [2, 4), ...; an interval's process has the interval's length as rate, and each of
its points a register and a place on the axis. A point counts where its place is below the count of
the shingle. The points of a register come at the rate of the document's whole weight, so its first
point is the same in two documents with probability of their weighted Jaccard similarity. Points
are made in order of time up to a bound per document at which all registers are filled almost
surely; documents with an empty register go on to a larger bound.

Groups. Equal multisets are one node from the start. Nodes that agree in one of ``bands`` bands
are candidates. In a bucket, and later in a family of linked candidates, a search from member to
member compares those it has reached with those it has not, so its cost falls with what is linked
and only a spanning forest leaves the task, never all pairs. Buckets and families above ``block``
members are dealt out as pairs of blocks, so no task holds more than two blocks and every pair of
members still meets. Buckets link by signatures (at ``screen``, well below ``least``), families
then by exact multiset overlap; components of exact links are the groups. Two documents at
similarity ``least`` share no bucket with probability (1 - least^rows)^bands, 3e-6 as set here.

Nodes are known by a 64-bit hash of the multiset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.llm.columns import mix, shingles, slices, split_words, uniform
from calibrant.llm.components import connected
from calibrant.llm.tables import shuffle_width, written

_STEP, _SPOT = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)
_REGISTER, _PLACE = np.uint64(0xB564EF22EC7AECE5), np.uint64(0xF7C2EBC08F67F2B5)
_TURN = 0x3C6EF372


@dataclass(frozen=True)
class Near:
    """Parameters of a near-duplicate search."""

    width: int = 5
    least: float = 0.8
    bands: int = 24
    rows: int = 4
    screen: float = 0.6     # 5 standard deviations below ``least`` at 96 registers
    block: int = 4096

    @property
    def registers(self) -> int:
        return self.bands * self.rows


@dataclass
class Bags:
    """Multisets of several documents: distinct shingles, counts, and the first of each document."""

    grams: np.ndarray
    counts: np.ndarray
    first: np.ndarray

    @property
    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def weights(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.counts)])
        return total[self.first[1:]] - total[self.first[:-1]]


def bags_of(texts: pa.Array, width: int) -> Bags:
    grams, document = shingles(split_words(texts), width)
    order = np.lexsort((grams, document))
    grams, document = grams[order], document[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (document[1:] != document[:-1])
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(grams)))
    first = np.searchsorted(document[begin], np.arange(len(texts) + 1))
    return Bags(grams[begin], counts, first)


def nodes_of(bags: Bags) -> np.ndarray:
    """A 64-bit hash of each multiset; 0 for an empty one."""
    each = mix(mix(bags.grams) + bags.counts.astype(np.uint64) * _SPOT)
    total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
    sums = total[bags.first[1:]] - total[bags.first[:-1]]
    return np.where(np.diff(bags.first) > 0, mix(sums + np.uint64(1)) | np.uint64(1), np.uint64(0))


def signatures(bags: Bags, registers: int) -> np.ndarray:
    """For each document and register a hash of the register's first point; 0 without shingles."""
    weights, documents = bags.weights, bags.documents
    intervals = [(0, 1)]
    while intervals[-1][1] < (bags.counts.max() if len(bags.counts) else 0):
        intervals.append((intervals[-1][1], 2 * intervals[-1][1]))
    out = np.zeros((len(weights), registers), dtype=np.uint64)
    todo = weights > 0
    bound = np.zeros(len(weights))
    bound[todo] = registers * (np.log(registers) + 3) / weights[todo]
    while todo.any():
        best = np.full((len(weights), registers), np.inf)
        chosen = todo[documents]
        points = [
            _points(bags.grams[part], documents[part], bags.counts[part], bound, low, high, registers)
            for low, high in intervals if (part := chosen & (bags.counts > low)).any()]
        cell, time, name = (np.concatenate(column) for column in zip(*points))
        np.minimum.at(best.reshape(-1), cell, time)
        first = time == best.reshape(-1)[cell]
        out.reshape(-1)[cell[first]] = name[first]
        todo &= np.isinf(best).any(axis=1)
        bound[todo] *= 2
    return out


def _points(
    grams: np.ndarray, document: np.ndarray, counts: np.ndarray, bound: np.ndarray, low: int,
    high: int, registers: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of one interval up to each document's bound: cell, time and identity."""
    cells, times, names = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.uint64)]
    seed = mix(grams + mix(np.array([high])))
    time, end = np.zeros(len(grams)), bound[document]
    number = 0
    while len(seed):
        number += 1
        draw = mix(seed + mix(np.array([number]) ^ _TURN))
        time = time - np.log(uniform(draw)) / (high - low)
        alive = time <= end
        seed, time, end, document, counts, draw = (
            x[alive] for x in (seed, time, end, document, counts, draw))
        register = (mix(draw ^ _REGISTER) % np.uint64(registers)).astype(np.int64)
        place = low + (high - low) * uniform(mix(draw ^ _PLACE))
        kept = place < counts
        cells.append((document * registers + register)[kept])
        times.append(time[kept])
        names.append(draw[kept])
    return np.concatenate(cells), np.concatenate(times), np.concatenate(names)


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of ``rows`` registers, different from band to band."""
    bands = signature.shape[1] // rows
    out = np.tile(np.arange(bands, dtype=np.uint64) * _STEP, (len(signature), 1))
    for r in range(rows):
        out = mix(out + signature[:, r::rows])
    return out


def _described(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, row (a hash of id and text), node, bands and signature (32 bits a register)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                bags = bags_of(part.column(2), near.width)
                node = nodes_of(bags)
                found = signatures(bags, near.registers)
                bands = band_hashes(found, near.rows)
                keep = (found >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array(node.view(np.int64), mask=node == 0),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(len(node) + 1, dtype=np.int32) * near.bands),
                         pa.array(bands.reshape(-1).view(np.int64))),
                     pa.array([row.tobytes() for row in keep], pa.binary())],
                    names=["doc_id", "row", "node", "bands", "signature"])

    return _keyed(docs).mapInArrow(
        run, "doc_id bigint, row bigint, node bigint, bands array<bigint>, signature binary")


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), row_key().alias("row"), text.alias("text"))


def row_key():
    """A hash of a row's id and text; repeated rows have the same."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def _multisets(docs: DataFrame, near: Near) -> DataFrame:
    """node, and the multiset packed as sorted hashes followed by counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                bags = bags_of(part.column(2), near.width)
                blobs = [
                    bags.grams[a:b].tobytes() + bags.counts[a:b].astype("<u4").tobytes()
                    for a, b in zip(bags.first, bags.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes_of(bags).view(np.int64)), pa.array(blobs, pa.binary())],
                    names=["node", "bag"])

    return _keyed(docs).mapInArrow(run, "node bigint, bag binary")


def _agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).mean(axis=1)


def _forest(n: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among ``n`` members.

    ``alike(i, others)`` tells which of ``others`` are linked with ``i``. Members reached are
    compared only with members not yet reached, so nothing is compared once all are linked.
    """
    left = np.arange(n)
    while len(left):
        reached, left = [int(left[0])], left[1:]
        for member in reached:
            if not len(left):
                break
            linked = alike(member, left)
            for other in left[linked]:
                yield member, int(other)
            reached += left[linked].tolist()
            left = left[~linked]


def _in_blocks(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Members of groups dealt out as pairs of blocks; ``sizes`` has ``key`` and ``n`` > 1."""
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    # Block i meets every block j; the pair is named by the smaller one first.
    return (
        members.join(sizes.withColumn("parts", parts).drop("n"), "key")
        .withColumn("mine", mine)
        .withColumn("pair", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda other: F.xxhash64(
                "key", F.least(other, F.col("mine")), F.greatest(other, F.col("mine"))))))
        .drop("key", "parts", "mine"))


def _linked(
    dealt: DataFrame, payload: str, links: Callable[[list[bytes]], Iterator[tuple[int, int]]],
) -> DataFrame:
    """Edges (a, b) of a spanning forest in every group ``pair``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, payloads in _groups(batches):
            found = list(links(payloads)) if len(nodes) > 1 else []
            if found:
                one, two = (np.array(side) for side in zip(*found))
                named = np.array(nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(named[one]), pa.array(named[two])], names=["a", "b"])

    width = shuffle_width(dealt.sparkSession)
    return dealt.select("pair", "node", payload).repartition(width, "pair").sortWithinPartitions(
        "pair", "node").mapInArrow(run, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    now, nodes, payloads = None, [], []
    for batch in batches:
        for pair, node, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if pair != now and nodes:
                yield nodes, payloads
                nodes, payloads = [], []
            now = pair
            nodes.append(node)
            payloads.append(payload)
    if nodes:
        yield nodes, payloads


def _forest_by_signature(near: Near):
    def links(payloads: list[bytes]) -> Iterator[tuple[int, int]]:
        found = np.frombuffer(b"".join(payloads), dtype="<u4").reshape(len(payloads), -1)
        return _forest(len(found), lambda i, others: _agreement(
            found[i], found[others]) >= near.screen)

    return links


def _forest_by_overlap(near: Near):
    size = 4 * near.registers

    def links(payloads: list[bytes]) -> Iterator[tuple[int, int]]:
        found = np.frombuffer(
            b"".join(p[:size] for p in payloads), dtype="<u4").reshape(len(payloads), -1)
        grams, counts = [], []
        for payload in payloads:
            n = (len(payload) - size) // 12
            grams.append(np.frombuffer(payload, dtype=np.uint64, count=n, offset=size))
            counts.append(np.frombuffer(payload, dtype="<u4", offset=size + 8 * n).astype(np.int64))
        weight = np.array([c.sum() for c in counts])

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            out = _agreement(found[i], found[others]) >= near.screen
            out &= np.minimum(weight[others], weight[i]) >= near.least * np.maximum(
                weight[others], weight[i])
            for at in np.flatnonzero(out):
                j = others[at]
                _, x, y = np.intersect1d(
                    grams[i], grams[j], assume_unique=True, return_indices=True)
                shared = int(np.minimum(counts[i][x], counts[j][y]).sum())
                out[at] = shared >= near.least * (weight[i] + weight[j] - shared) - 1e-9
            return out

        return _forest(len(payloads), alike)

    return links


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def near_groups(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, row, group, class_id (the group's smallest doc_id) of every row of ``docs``.

    NULL ids are no smallest id unless a group has no other. Repeated rows without words are a
    group, and no others are.
    """
    described = written(_described(docs, near), "signatures")
    # One row per multiset: copies meet here, after a map-side combine.
    nodes = written(
        described.filter("node is not null").groupBy("node").agg(
            F.first("bands").alias("bands"), F.first("signature").alias("signature"),
            F.first("row").alias("row"), F.min("doc_id").alias("lowest")), "nodes")
    members = nodes.select(F.explode("bands").alias("key"), "node")
    candidates = _in_blocks(members, _sizes(members), near.block).join(
        nodes.select("node", "signature"), "node")
    families = written(connected(_linked(candidates, "signature", _forest_by_signature(near))),
                       "families")
    chosen = nodes.join(families, "node").select("node", "row", "signature", "component")
    texts = docs.select(row_key().alias("_row"), "doc_id", "text").join(
        chosen.select(F.col("row").alias("_row")).distinct(), "_row", "left_semi")
    bags = _multisets(texts, near).groupBy("node").agg(F.first("bag").alias("bag"))
    whole = chosen.join(bags, "node").select(
        F.col("component").alias("key"), "node", F.concat("signature", "bag").alias("whole"))
    sizes = _sizes(families.select(F.col("component").alias("key")))
    groups = connected(
        _linked(_in_blocks(whole, sizes, near.block), "whole", _forest_by_overlap(near)))
    placed = nodes.select("node", "lowest").join(groups, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("lowest").alias("class_id"))
    classes = placed.join(lowest, "component").select("node", "component", "class_id")
    wordless = F.col("node").isNull()
    return described.select("doc_id", "row", "node").join(classes, "node", "left").select(
        "doc_id", "row", F.when(wordless, F.col("row")).otherwise(F.col("component")).alias("group"),
        F.when(wordless, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def class_table(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, class_id, kept (the document with the smallest id of its class)."""
    return near_groups(docs, near).select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row of every group, with the columns of ``docs``: the one with the smallest id."""
    kept = near_groups(docs, near).groupBy("group").agg(
        F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    # Repeated rows are combined before the shuffle, and the join uses the same partitioning.
    rows = docs.select(F.struct("*").alias("document"), row_key().alias("row"))
    return rows.groupBy("row").agg(F.first("document").alias("document")).join(
        kept.select("row"), "row", "left_semi").select("document.*")
