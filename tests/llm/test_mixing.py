import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from calibrant.llm import mixing
from calibrant.llm.catalog import QUERIES
from calibrant.llm.mixing import Mix, split_quotas, with_targets


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes):
    """Targets of the sources in order, by the definition: weights 1, 2, 3; at most three times."""
    weights, full = [i % 3 + 1 for i in range(len(sizes))], set()
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        want = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if want[i] > 3 * sizes[i]}
        if not over:
            return [want.get(i, 3.0 * sizes[i]) for i in range(len(sizes))]
        full |= over


def verify(rows, got, mix=Mix()):
    """``rows``: (doc_id, text, source); ``got``: rows of the query."""
    totals = {}
    for _, text, source in rows:
        totals[source] = totals.get(source, 0) + words(text)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, shares([totals[s] for s in order])))
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (r[0] for r in rows)))
    where = {(r[0], words(r[1])): r[2] for r in rows}
    taken, longest = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    for r in got:
        source = where[r.doc_id, r.size]
        assert r.source_size == totals[source]
        assert r.target == pytest.approx(targets[source], rel=1e-9)
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[source] += r.taken
        longest[source] = max(longest[source], r.size)
    for source in order:
        # The last document taken is the one that comes nearest.
        assert abs(taken[source] - targets[source]) <= longest[source] / 2 + 1e-6


@pytest.mark.parametrize("directory", ["sf0.001", "sf0.01"])
def test_query(spark, directory):
    folder = f"/root/testdata/{directory}"
    rows = [(r.doc_id, r.text, r.source) for r in
            spark.read.parquet(f"{folder}/documents.parquet").collect()]
    first = QUERIES["op10_mix_sources"](spark, folder)
    verify(rows, first.collect())
    assert cases.table(first) == cases.table(QUERIES["op10_mix_sources"](spark, folder))


def many():
    rng = np.random.default_rng(4)
    return [(i, "w " * int(rng.integers(1, 60)), "en", "hot" if i % 3 else f"s{i % 11}", 1)
            for i in range(900)]


@pytest.mark.parametrize("mix", [
    Mix(block_words=50, shard_words=700), Mix(block_words=1000, shard_words=100),
    Mix(most_blocks=3, most_shards=5, shard_words=10)])
def test_blocks_and_shards(spark, mix):
    rows = many()
    docs = spark.createDataFrame(rows, cases.DOCS)
    table = mixing.mix_table(docs, mix).collect()
    verify([(r[0], r[1], r[3]) for r in rows], table, mix)
    copies = {r.doc_id: len(r.shards) for r in table}
    mixed = mixing.mix_documents(docs, mix)
    assert mixed.columns == docs.columns
    found = {}
    for row in mixed.collect():
        found[row.doc_id] = found.get(row.doc_id, 0) + 1
    assert found == {i: n for i, n in copies.items() if n}
    shards = math.ceil(sum(r.size for r in table) / mix.shard_words)
    shards = min(mix.most_shards, shards)
    used = [shard for r in table for shard in r.shards]
    assert set(used) <= set(range(shards)) and len(set(used)) >= min(5, shards)


def test_order_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(many(), cases.DOCS)
    one = mixing.mix_table(docs.repartition(1))
    many_ = mixing.mix_table(docs.repartition(7, "text"))
    assert cases.table(one) == cases.table(many_)


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    docs = cases.docs(spark, clashing=clashing)
    got = mixing.mix_table(docs).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(r[0]) for r in cases.ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].size == by_id[3].size == by_id[4].size == 0
    assert by_id[6].size == 30_000 and by_id[10].size == words(cases.ROWS[12][1])
    assert all(r.taken <= 3 * r.size for r in got)
    mixed = mixing.mix_documents(docs)
    assert mixed.dtypes == docs.dtypes
    assert mixed.count() == sum(len(r.shards) for r in got)


def test_empty_tables(spark):
    assert mixing.mix_table(cases.docs(spark, [])).collect() == []
    assert mixing.mix_documents(cases.docs(spark, [])).collect() == []
    blank = cases.docs(spark, [(1, None, None, "a", 0), (2, " ", None, None, 0)])
    assert [(r.size, r.taken, r.target) for r in mixing.mix_table(blank).collect()] == [(0, 0, 0.0)] * 2


def test_too_many_sources_is_an_error(spark):
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_table(spark.createDataFrame(many(), cases.DOCS), Mix(most_sources=3))


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1, 1000], [0, 5, 0, 7], [1000, 1, 1, 1, 1], []])
def test_targets(spark, sizes):
    sources = spark.createDataFrame(
        [(i, n, float(i % 3 + 1)) for i, n in enumerate(sizes)], "i int, size bigint, weight double")
    got = [r.target for r in with_targets(sources, (1, 2, 3), 3).orderBy("i").collect()]
    assert sum(got) == pytest.approx(sum(sizes))
    assert got == pytest.approx(shares(sizes) if sizes else [])


@pytest.mark.parametrize("few", [True, False])
def test_many_sources(spark, monkeypatch, few):
    """Thousands of sources, one with a third of the rows; tables broadcast or joined with salts."""
    monkeypatch.setattr(mixing, "FEW", 1 << 17 if few else 0)
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 9)), "en", None if i % 3 == 0 else f"s{i}", 1) for i in range(4500)]
    docs = spark.createDataFrame(rows, cases.DOCS)
    mix = Mix(block_words=20, shard_words=1500)
    table = mixing.mix_table(docs, mix).collect()
    verify([(r[0], r[1], r[3]) for r in rows], table, mix)
    shards = math.ceil(sum(r.size for r in table) / 1500)
    held = [0] * shards
    for r in table:
        for shard in r.shards:
            held[shard] += r.size
    assert sum(held) and max(held) < 2 * sum(held) / shards


def test_tree_with_sizes_of_shards():
    rng = np.random.default_rng(1)
    units = rng.integers(0, 6, 200)
    capacity = rng.multinomial(units.sum(), [0.5, 0, 0.2, 0.3])
    quotas = np.zeros((200, 4), dtype=np.int64)
    for shard, rows, draws in mixing.leaves(units, capacity, [3, 1]):
        quotas[rows, shard] = draws
    assert (quotas.sum(axis=1) == units).all() and (quotas.sum(axis=0) == capacity).all()


def test_splitting_tree():
    units = [700, 31, 1, 0, 268]
    draws = np.array([split_quotas(units, 8, seed) for seed in range(200)])
    assert (draws.sum(axis=2) == units).all() and (draws >= 0).all()
    assert (draws.sum(axis=1) == 125).all()
    # Every shard expects its share of every source, with the hypergeometric spread.
    expected = np.array(units) / 8
    variance = 125 * (np.array(units) / 1000) * (1 - np.array(units) / 1000) * 875 / 999
    assert np.allclose(draws.mean(axis=(0, 2)), expected)
    big = expected > 3
    assert np.allclose(draws.var(axis=(0, 2))[big], variance[big], rtol=0.25)
    assert (split_quotas(units, 8, 3) == split_quotas(units, 8, 3)).all()


def test_a_shard_is_a_partition(spark):
    rows = [(i, f"word{i} and eight more words in this text", "en", "abc"[i % 3], 1) for i in range(900)]
    mixed = mixing.mix_documents(cases.docs(spark, rows), mixing.Mix(shard_words=500, block_words=40))
    sizes = [row["n"] for row in mixed.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 12 and max(sizes) <= 2 * min(sizes)
