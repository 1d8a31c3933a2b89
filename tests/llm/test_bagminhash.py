from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import cases
import corpus_pipeline
from calibrant.llm import bagminhash
from calibrant.llm.bagminhash import Near
from calibrant.llm.catalog import QUERIES


def bag(text):
    w = (text or "").encode().lower().split()
    return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter(
        [tuple(w)] if w else [])


def similarity(one, two):
    shared = sum((one & two).values())
    return shared / (one.total() + two.total() - shared) if shared else 0.0


def groups(rows):
    """Per row the number of its group: single linkage at 0.8 over all pairs."""
    bags, root = [bag(text) for _, text in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, b in enumerate(bags):
        near = {j for gram in b for j in where.get(gram, ())}
        for j in near:
            if similarity(b, bags[j]) >= 0.8 - 1e-12:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for gram in b:
            where.setdefault(gram, []).append(i)
        if not b and rows[i] in rows[:i]:
            root[i] = find(rows.index(rows[i]))
    return [find(i) for i in range(len(rows))]


def expected(rows):
    out, place = [], groups(rows)
    for (doc_id, _), mine in zip(rows, place):
        ids = [rows[j][0] for j, other in enumerate(place) if other == mine and rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((doc_id, low, doc_id == low))
    return sorted(out, key=repr)


@pytest.mark.parametrize("directory", ["sf0.001", "sf0.01"])
def test_query(spark, directory):
    folder = f"/root/testdata/{directory}"
    rows = [(row.doc_id, row.text) for row in
            spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = expected(rows)
    assert cases.table(QUERIES["op5_bagminhash"](spark, folder)) == want
    assert any(not kept for _, _, kept in want)


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    got = bagminhash.class_table(cases.docs(spark, clashing=clashing))
    assert cases.table(got) == expected([row[:2] for row in cases.ROWS])


def test_empty_table(spark):
    assert bagminhash.class_table(cases.docs(spark, [])).collect() == []


def family(n, step, words=60):
    """Texts in a row, each ``step`` words further: neighbours alike, the ends not."""
    return [(100 + i, " ".join(f"w{k}" for k in range(i * step, i * step + words)))
            for i in range(n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_chains_and_stars_in_blocks(spark, block):
    """Groups whose members are not all alike, also when they are dealt out in small blocks."""
    base = " ".join(f"s{k}" for k in range(120))
    star = [(500 + i, base + " " + " ".join(f"t{i}x{k}" for k in range(14))) for i in range(12)]
    rows = family(9, 2) + star + [(900, base)]
    want = expected(rows)
    assert len({low for _, low, _ in want}) == 2
    docs = spark.createDataFrame([(*row, "en", "a", 1) for row in rows], cases.DOCS)
    assert cases.table(bagminhash.class_table(docs, Near(block=block))) == want


def test_counts_matter(spark):
    """The same shingles with other counts are other documents."""
    cycle = "a b c d e "
    rows = [(1, cycle * 40), (2, cycle * 39), (3, cycle * 10), (4, cycle * 40)]
    docs = spark.createDataFrame([(*row, "en", "a", 1) for row in rows], cases.DOCS)
    got = {row.doc_id: row.class_id for row in bagminhash.class_table(docs).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 3}


@pytest.mark.parametrize("pair", [
    ("a b c d e f g h " * 5, "a b c d e f g h " * 3),
    (" ".join(f"x{i}" for i in range(90)), " ".join(f"x{i}" for i in range(30, 110))),
    ("p q r s t " * 30 + " ".join(f"y{i}" for i in range(40)), "p q r s t " * 9 + "z " * 20),
])
def test_signatures_estimate_without_bias(pair):
    bags = bagminhash.bags_of(pa.array(pair), 5)
    found = bagminhash.signatures(bags, 20_000)
    true = similarity(bag(pair[0]), bag(pair[1]))
    got = (found[0] == found[1]).mean()
    assert got == pytest.approx(true, abs=4.5 * np.sqrt(true * (1 - true) / 20_000))


def test_signatures_do_not_depend_on_the_batch():
    texts = [row[1] for row in cases.ROWS]
    whole = bagminhash.signatures(bagminhash.bags_of(pa.array(texts, pa.string()), 5), 96)
    for i, text in enumerate(texts):
        alone = bagminhash.signatures(bagminhash.bags_of(pa.array([text], pa.string()), 5), 96)
        assert np.array_equal(alone[0], whole[i])


def test_stage_keeps_one_of_each_group(spark):
    docs = cases.docs(spark, clashing=True)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    rows = [row[:2] for row in cases.ROWS]
    best = {}
    for (doc_id, _), mine in zip(rows, groups(rows)):
        best.setdefault(mine, []).append(doc_id)
    want = sorted((min((i for i in ids if i is not None), default=None) for ids in best.values()),
                  key=repr)
    assert sorted((row.doc_id for row in got.collect()), key=repr) == want
