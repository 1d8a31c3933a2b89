import numpy as np
import pytest

import cases
from calibrant.llm import vector_search
from calibrant.llm.catalog import QUERIES
from calibrant.llm.vector_search import Search

SCHEMA = "vec_id bigint, embedding array<float>"


def usable(v, size):
    return bool(v) and len(v) == size and any(v) and all(
        x is not None and np.isfinite(x) for x in v)


def expected(rows, every, size=None, k=5):
    """Per length of the vectors, or of one length."""
    if size is None:
        sizes = {len(v) for _, v in rows if v}
        return {q: found for s in sizes for q, found in expected(rows, every, s, k).items()}
    rows = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and usable(v, size)]
    if not rows:
        return {}
    ids = np.array([i for i, _ in rows])
    units = np.array([v / np.linalg.norm(v) for _, v in rows])
    out = {}
    for q in sorted({int(i) for i in ids if i % every == 0}):
        score = units @ units[np.flatnonzero(ids == q)[0]]
        other = np.flatnonzero(ids != q)
        best = other[np.lexsort((ids[other], -np.round(score[other], 12)))][:k]
        out[q] = [(int(ids[b]), float(score[b])) for b in best]
    return out


def answers(df):
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    for found in out.values():
        assert [rank for rank, _, _ in found] == list(range(1, len(found) + 1))
        assert all(a[2] >= b[2] for a, b in zip(found, found[1:]))
    return {q: [(v, s) for _, v, s in found] for q, found in out.items()}


def recall(got, want):
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        # A neighbour as near as the last true one is as good.
        last = want[q][-1][1] if want[q] else 0
        hits += sum(s >= last - 1e-12 for _, s in found)
        assert len(found) == len(want[q])
    return hits / max(1, sum(map(len, want.values())))


def test_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in
            spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = answers(QUERIES["op8_vector_search"](spark, folder)), expected(rows, 50, 64)
    assert recall(got, want) >= 0.9
    true = {i: np.float64(v) / np.linalg.norm(np.float64(v)) for i, v in rows}
    for q, found in got.items():
        for v, s in found:
            assert s == pytest.approx(float(true[q] @ true[v]), abs=1e-12)


def made(n, size=16, copies=0):
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(12, size))
    rows = [(i, (centers[i % 12] + 0.4 * rng.normal(size=size)).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(copies)]
    bad = n + copies + 50
    return rows + [
        (bad, None), (bad + 1, [0.0] * size), (bad + 2, [float("nan")] * size),
        (bad + 3, [None] * size), (bad + 4, [1.0]), (bad + 5, []), (None, rows[0][1])]


@pytest.mark.parametrize("settings", [
    {}, {"rows_block": 16, "queries_block": 4, "list_rows": 40}, {"block": 5}])
def test_a_third_of_all_rows_alike(spark, settings):
    rows = made(600, copies=300)
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows, 10, 16)
    got = answers(vector_search.search_table(df, 10, Search(**settings)))
    assert recall(got, want) >= 0.95
    # Ties go to the smaller id.
    assert [v for v, _ in got[600]] == [v for v, _ in want[600]]


@pytest.mark.parametrize("n", [1, 2, 5, 30])
def test_few_rows(spark, n):
    rows = made(n)[:n]
    got = answers(vector_search.search_table(spark.createDataFrame(rows, SCHEMA), 2))
    want = {q: found for q, found in expected(rows, 2, 16).items() if found}
    assert {q: [v for v, _ in found] for q, found in got.items()} == {
        q: [v for v, _ in found] for q, found in want.items()}


def test_clashing_columns_and_repeated_rows(spark):
    rows = made(50)
    df = spark.createDataFrame([*rows, rows[10], rows[11]], SCHEMA).selectExpr(
        "*", "1 AS v", "2 AS `list`", "'x' AS label")
    got = answers(vector_search.search_table(df, 10))
    assert set(got) == {0, 10, 20, 30, 40}
    assert 10 not in [v for v, _ in got[10]]


def test_empty_table(spark):
    assert vector_search.search_table(spark.createDataFrame([], SCHEMA)).collect() == []


def test_candidates_are_abandoned_early():
    """The scan finds the nearest although most candidates lose the test."""
    rng = np.random.default_rng(0)
    points = rng.normal(size=(2000, 64))
    points[:6] = points[0] + 0.05 * rng.normal(size=(6, 64))
    index = vector_search.fit(points, len(points), Search())
    found = list(vector_search.scan(
        index, Search(), points[:1], np.array([0]), points, np.arange(2000)))
    assert set(found[0][1].tolist()) == {1, 2, 3, 4, 5}


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(4, 16, 16)[i % 3]).tolist()) for i in range(600)]
    rows += [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (1002, [1.0])]
    got = answers(vector_search.search_table(spark.createDataFrame(rows, SCHEMA), 50))
    want = {q: found for q, found in expected(rows, 50).items() if found}
    assert recall(got, want) >= 0.9 and got[1000] == [(1001, pytest.approx(0.8))]
