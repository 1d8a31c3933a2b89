import random

import pytest

from calibrant.llm.components import connected


def expected(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


rng = random.Random(1)
CASES = {
    "none": [],
    "loops": [(1, 1), (2, 2)],
    "path": [(i, i + 1) for i in range(60)],
    "star": [(0, i) for i in range(1, 200)] + [(500, 0)],
    "random": [(rng.randint(-99, 99), rng.randint(-99, 99)) for _ in range(90)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = CASES[name]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {row.node: row.component for row in connected(df).collect()}
    assert got == expected([e for e in edges if e[0] != e[1]])
