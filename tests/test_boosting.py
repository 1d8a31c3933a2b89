"""Boosted trees against a version that sums over rows, and their defined results."""

import math
import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from calibrant.operators import boosting
from calibrant.operators.boosting import Boosting
from calibrant.operators.ceiling import boosted_forecast

SCHEMA = "a double, b double, outcome int"


def rows(n=600, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.choice([None, math.nan, *range(8)])
        b = round(rng.uniform(-1, 1), 1)
        low = 0.8 if a is None or a != a else 0.1 + 0.08 * a
        out.append((None if a is None else float(a), b, int(rng.random() < low * (0.6 if b > 0 else 1))))
    return out


def brute(data, cuts, settings):
    """Trees by sums over rows: returns a function of (a, b)."""
    def place(x, edges):
        return None if x is None or x != x else sum(e < x for e in edges)

    points = [tuple(place(x, e) for x, e in zip(r[:2], cuts)) for r in data]
    y = [r[2] for r in data]
    base = math.log(sum(y) / (len(y) - sum(y)))
    scores, trees = [base] * len(y), []

    def leaf(rows_, g, h):
        return -settings.rate * sum(g[i] for i in rows_) / (sum(h[i] for i in rows_) + settings.l2)

    def worth(rows_, g, h):
        return sum(g[i] for i in rows_) ** 2 / (sum(h[i] for i in rows_) + settings.l2)

    def grow(rows_, depth, g, h):
        best, chosen = 1e-9, None
        if depth:
            for f in range(2):
                gone = [i for i in rows_ if points[i][f] is None]
                for cut in range(len(cuts[f]) + (1 if gone else 0)):
                    for side in ((True, False) if gone else (None,)):
                        left = [i for i in rows_ if (side if points[i][f] is None else points[i][f] <= cut)]
                        right = [i for i in rows_ if i not in set(left)]
                        if min(len(left), len(right)) < settings.least_rows:
                            continue
                        gain = worth(left, g, h) + worth(right, g, h) - worth(rows_, g, h)
                        if gain > best + 1e-9:
                            to = side if gone else len(left) >= len(right)
                            best, chosen = gain, (f, cut, to, left, right)
        if chosen is None:
            value = leaf(rows_, g, h)
            return lambda p: value
        f, cut, to, left, right = chosen
        one, two = grow(left, depth - 1, g, h), grow(right, depth - 1, g, h)
        return lambda p: (one if (to if p[f] is None else p[f] <= cut) else two)(p)

    for _ in range(settings.rounds):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        tree = grow(list(range(len(y))), settings.depth, [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p])
        trees.append(tree)
        scores = [s + tree(x) for s, x in zip(scores, points)]

    def forecast(a, b):
        at = (place(a, cuts[0]), place(b, cuts[1]))
        return 1 / (1 + math.exp(-(base + sum(t(at) for t in trees))))

    return forecast


@pytest.mark.parametrize("settings", [
    Boosting(rounds=3, depth=1, rate=0.3), Boosting(rounds=4, depth=3, rate=0.2, kept_trees=2)])
def test_equals_sums_over_rows(spark, settings):
    data = rows(300)
    df = spark.createDataFrame(data, SCHEMA)
    booster = boosting.fit(df, ["a", "b"], settings=settings)
    forecast = brute(data, booster.cuts, settings)
    got = df.withColumn("p", booster.probability()).collect()
    assert len({round(r.p, 9) for r in got}) > 1
    for r in got:
        assert r.p == pytest.approx(forecast(r.a, r.b), abs=1e-6)


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    settings = Boosting(rounds=5, depth=3, kept_trees=2)
    cuts = {"a": [i + 0.5 for i in range(7)], "b": [-0.5, 0, 0.5]}
    one = boosting.fit(df.coalesce(1), ["a", "b"], settings=settings, cuts=cuts).forest
    two = boosting.fit(df.repartition(7, "b"), ["a", "b"], settings=settings, cuts=cuts).forest
    for a, b in zip((one.feature, one.last, one.missing_left, one.leaf),
                    (two.feature, two.last, two.missing_left, two.leaf)):
        assert (a == b).all()


def test_missing_values_have_a_side(spark):
    """Half of the positives are known by a missing value alone; a median would hide them."""
    data = [(None if i % 2 else float(i % 10), 0.0, i % 2) for i in range(400)]
    df = spark.createDataFrame(data, SCHEMA)
    booster = boosting.fit(df, ["a", "b"], settings=Boosting(rounds=30, depth=2, rate=0.3))
    for r in df.withColumn("p", booster.probability()).collect():
        assert abs(r.p - r.outcome) < 0.05


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    alike = spark.createDataFrame([(1.0, None, 1), (None, math.nan, 1), (2.0, 1.0, None)], SCHEMA)
    for df, p in ((empty, 0.5), (alike, 1.0)):
        booster = boosting.fit(df, ["a", "b"])
        assert len(booster.forest) == 0
        got = alike.withColumn("p", booster.probability()).collect()
        assert [r.p for r in got] == pytest.approx([p] * 3, abs=1e-8)


def test_refuses_other_outcomes(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2)], SCHEMA)
    with pytest.raises(Exception, match="0 or 1"):
        boosting.fit(df, ["a", "b"])


def test_learns_more_than_the_base_rate(spark):
    data = rows(4000, seed=5)
    train, held = spark.createDataFrame(data[:3000], SCHEMA), spark.createDataFrame(data[3000:], SCHEMA)
    got = boosted_forecast(train, held, ["a", "b"], settings=Boosting(rounds=60)).collect()
    base = np.mean([r[2] for r in data[:3000]])
    brier = np.mean([(r.boosted - r.outcome) ** 2 for r in got])
    assert set(got[0].asDict()) == {"a", "b", "outcome", "boosted"}
    assert brier < 0.93 * np.mean([(base - r.outcome) ** 2 for r in got])


def test_blocks_of_any_size_give_the_same_trees(spark, monkeypatch):
    """Scores that are written after every tree, and never; one batch a block, and many."""
    df = spark.createDataFrame(rows(2000), SCHEMA)
    cuts = {"a": [i + 0.5 for i in range(7)], "b": [i / 10 for i in range(-9, 10)]}
    forests = []
    for kept, block, parts in ((1, 1 << 16, 3), (100, 1, 2)):
        monkeypatch.setattr(boosting, "BLOCK", block)
        forests.append(boosting.fit(df.repartition(parts), ["a", "b"], cuts=cuts, settings=Boosting(
            rounds=4, depth=3, rate=0.3, kept_trees=kept)).forest)
    for other in forests[1:]:
        assert (forests[0].feature == other.feature).all() and (forests[0].last == other.last).all()
        assert (forests[0].missing_left == other.missing_left).all()
        assert forests[0].leaf == pytest.approx(other.leaf, abs=1e-9)


def test_sums_of_many_blocks(spark):
    """Above 64 tasks sums meet in a tree of tasks."""
    cells = boosting._Cells(np.array([[0, 1, -1]], np.int16), np.array([3, 1, 2]), np.array([1, 0, 2]),
                            np.zeros(3), np.zeros(3)).weighed()
    blocks = spark.sparkContext.parallelize([cells] * 70, 80)
    found = boosting._histograms(blocks, boosting.Tree(2), 0, np.zeros(2, np.int64), (1, 1, 3, 3))
    expected = np.zeros((1, 1, 3, 3), np.int64)
    cells.add_to(expected, np.zeros(3, np.int64))
    assert (found == 70 * expected).all() and found.any()


def test_a_level_is_one_job_without_a_shuffle(spark):
    """Rounds add no stage but the passes over cells that are kept."""
    df, context = spark.createDataFrame(rows(), SCHEMA), spark.sparkContext
    stages = []
    for rounds in (2, 8):
        context.setJobGroup(f"boosting of {rounds} rounds", "")
        boosting.fit(df, ["a", "b"], settings=Boosting(rounds=rounds, depth=3))
        tracker = context.statusTracker()
        jobs = tracker.getJobIdsForGroup(f"boosting of {rounds} rounds")
        stages.append(sum(len(tracker.getJobInfo(job).stageIds) for job in jobs))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert stages[1] - stages[0] <= 6 * 3


def test_sums_of_cells_too_heavy_for_doubles():
    n, y = np.array([1 << 30, (1 << 30) + 1, 5]), np.array([1, 0, 2])
    cells = boosting._Cells(np.array([[0, 0, -1]], np.int16), n, y, np.full(3, 0.1), np.zeros(3)).weighed()
    p = 1 / (1 + math.exp(-0.1))
    g, h = round(p * boosting.ONE), round(p * (1 - p) * boosting.ONE)
    sums = np.zeros((1, 1, 3, 3), np.int64)
    cells.add_to(sums, np.zeros(3, np.int64))
    assert sums[0, 0].tolist() == [
        [5 * g - 2 * boosting.ONE, 5 * h, 5],
        [int(sum(n[:2])) * g - boosting.ONE, int(sum(n[:2])) * h, int(sum(n[:2]))], [0, 0, 0]]


def opened(rng, rows, features, top):
    """A block as it is read from written cells, and its ranges."""
    ranges = rng.integers(-1, top + 1, (features, rows)).astype(np.int16)
    n = rng.integers(1, 4, rows)
    table = pa.table({**{f"b{i}": x for i, x in enumerate(ranges)}, "n": n, "y": n // 2, "score": rng.normal(0, 1, rows)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return boosting._opened(features, Row(block=sink.getvalue().to_pybytes())), ranges, n


@pytest.mark.parametrize("top", [254, 300])
def test_blocks_in_few_bytes(top):
    """A block is read at every level: half the bytes, the same nodes and sums as row by row."""
    rng = np.random.default_rng(3)
    cells, ranges, n = opened(rng, 3000, 5, top)
    assert len(pickle.dumps(cells)) / 3000 < (32 if top == 254 else 37)
    tree = boosting.Tree(7)
    for i in range(1, 128):
        if i % 5:
            tree.feature[i], tree.last[i], tree.missing_left[i] = i % 5, rng.integers(0, top), i % 2
    nodes = cells.nodes(tree, 7)
    for k in range(0, 3000, 7):
        node = 1
        for _ in range(7):
            x = ranges[tree.feature[node], k]
            node = 2 * node + int(not tree.missing_left[node] if x < 0 else x > tree.last[node])
        assert nodes[k] == node
    slot = np.where(np.arange(256) % 3 == 0, -1, np.arange(256) % 2)
    sums = np.zeros((5, 2, top + 3, 3), np.int64)
    cells.add_to(sums, slot[nodes])
    expected = np.zeros_like(sums)
    for f in range(5):
        for k in np.flatnonzero(slot[nodes] >= 0):
            expected[f, slot[nodes[k]], ranges[f, k] + 1] += [cells.g[k], cells.h[k], n[k]]
    assert (sums == expected).all()


def test_imports_are_spared_once_a_worker(monkeypatch):
    """To ask each time how many objects are spared takes longer than a block."""
    def asked():
        raise AssertionError("counted all spared objects")

    monkeypatch.setattr(boosting.gc, "get_freeze_count", asked)
    cells, _, _ = opened(np.random.default_rng(1), 50, 2, 9)
    try:
        for _ in range(2):
            cells = boosting._after(boosting.Tree(2), cells)
    finally:
        boosting.gc.unfreeze()
