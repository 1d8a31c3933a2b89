import numpy as np
import pytest

import cases
from calibrant.llm import itq
from calibrant.llm.catalog import QUERIES
from calibrant.llm.itq import Quantisation

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows, least=0.98):
    n, good = len(rows), []
    for _, v, label in rows:
        good.append(bool(v) and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v))
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    units = [np.float32(v).astype(float) if ok else None for (_, v, _), ok in zip(rows, good)]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    for i in range(n):
        for j in range(i):
            same = good[i] and good[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
            if same and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None),
                  default=None)
        out.append((vec_id, links[i], low, vec_id is None or vec_id == low))
    return sorted(out, key=repr)


def made(seed=1, n=240, size=32):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 == 0:
            center = rng.normal(size=size)
        spread = rng.choice([0.02, 0.12, 0.2, 0.5])
        rows.append((i, (center + spread * rng.normal(size=size)).tolist(), int(i // 8 % 3)))
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(n + 40, rows[5][1], None), (n + 41, rows[5][1], 7), (n + 41, rows[5][1], 7)]
    rows += [(n + 50, None, 1), (n + 51, [], 1), (n + 52, [0.0] * size, 1),
             (n + 53, [float("nan")] * size, 1), (n + 54, [None] * size, 1),
             (n + 55, [float("inf")] * size, 1), (n + 56, [1.0, 2.0], 1), (None, rows[9][1], 1),
             (n + 57, [1e-30 * x for x in rows[5][1]], rows[5][2])]
    return rows


@pytest.mark.parametrize("block", [7, 4096])
def test_links_as_by_brute_force(spark, block):
    """A third of the vectors are one and the same, and blocks may be small."""
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    got = cases.table(itq.link_vectors(df, Quantisation(block=block)))
    assert got == expected(rows)


def test_query(spark):
    """On sf0.1, which has links; every pair of every label."""
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in
            spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    units = np.array([v for _, v, _ in rows], dtype=float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (units @ units.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {row.vec_id: row for row in QUERIES["op6_itq"](spark, folder).collect()}
    assert len(got) == len(rows)
    assert {row[0]: int(k) for row, k in zip(rows, near.sum(axis=1))} == {
        i: row.n_links for i, row in got.items()}


def test_clashing_columns(spark):
    rows = made(3, 40)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS v", "2 AS node", "3 AS code")
    assert cases.table(itq.link_vectors(df)) == expected(rows)


@pytest.mark.parametrize("settings", [{}, {"most_codes": 1}])
@pytest.mark.parametrize("mean_cosine", [0.8, 0.9])
def test_links_of_vectors_with_a_common_direction(spark, mean_cosine, settings):
    """Near pairs differ in many bits once the mean is taken off; with one code all pairs meet."""
    rng = np.random.default_rng(8)
    n, size = 500, 64
    common = itq.unit(rng.normal(size=(1, size)))
    one = itq.unit(np.sqrt(mean_cosine) * common
                   + np.sqrt(1 - mean_cosine) * itq.unit(rng.normal(size=(n, size))))
    aim = rng.normal(size=(n, size))
    aim = itq.unit(aim - (aim * one).sum(axis=1, keepdims=True) * one)
    two = 0.981 * one + np.sqrt(1 - 0.981 ** 2) * aim
    points = np.float32(np.concatenate([one, two])).astype(float)
    units = itq.unit(points)
    near = (units @ units.T >= 0.98).sum() - len(points)
    df = spark.createDataFrame(
        [(i, v.tolist(), 1) for i, v in enumerate(points)], SCHEMA)
    got = sum(r.n_links for r in itq.link_vectors(df, Quantisation(**settings)).collect())
    assert near >= 2 * n and 0.97 * near <= got <= near


def test_empty_table(spark):
    assert itq.link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_nothing_usable(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], SCHEMA)
    assert cases.table(itq.link_vectors(df)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_codes_are_balanced_and_tighter_than_signs():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(3000, 32)) @ np.diag(np.linspace(0.2, 2, 32))
    coder = itq.learn(points, Quantisation(bits=32))
    bits = (coder.codes(points)[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
    assert (np.abs(bits.mean(axis=0) - 0.5) < 0.1).all()
    start = itq.learn(points, Quantisation(bits=32, rounds=0))

    def loss(c):
        projected = (itq.unit(points) - c.center) @ c.turn
        return ((np.where(projected > 0, 1, -1) / np.sqrt(32) - projected) ** 2).sum()

    assert loss(coder) < loss(start)


def test_every_pair_is_judged_once():
    rng = np.random.default_rng(6)
    parts = itq.part_bits(64, 4)
    codes = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = codes.copy()
    for bit in rng.integers(0, 64, (40, 6)).T:
        near ^= np.uint64(1) << bit.astype(np.uint64)
    for one, two in zip(codes, near):
        a, b = ({(t, k): int(r[0]) for t, k, r in itq._places(np.array([c]), parts)} for c in (one, two))
        judged = [place for place in a if a[place] == b[place] and itq._judged_here(
            np.array([one ^ two]), parts, *place)[0]]
        assert len(judged) == 1


@pytest.mark.parametrize("schema, label", [(SCHEMA, lambda i: i % 2), (
    "vec_id bigint, embedding array<float>, label string", lambda i: ["one", "two words"][i % 2])])
def test_lengths_and_labels_are_groups(spark, schema, label):
    """Every length is searched, not the most frequent one alone; labels need not be numbers."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=(2, 3, 16)[i % 3]).tolist(), label(i // 3)) for i in range(90)]
    rows += [(100 + i, [x * 2 for x in rows[i][1]], rows[i][2]) for i in range(0, 90, 4)]
    rows += [(200, [1.0, 1.0], label(0)), (201, [1.0, 1.0], label(0)), (202, [2.0, 2.0], label(0)),
             (203, [1.0, 1.0, 0.0], label(0)), (204, [1.0], label(0)), (205, [5.0], label(0))]
    got = cases.table(itq.link_vectors(spark.createDataFrame(rows, schema)))
    assert got == expected(rows)
