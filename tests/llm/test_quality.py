import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

import cases
import corpus_pipeline
from calibrant.llm import quality
from calibrant.llm.catalog import QUERIES
from calibrant.llm.quality import FEATURES, Network, Training, passage_features


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op9_quality"](spark, "/root/testdata/sf0.1").collect()


def test_query(spark, scored):
    labels = {row.doc_id: row.quality for row in
              spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(row.held_out == held_out(row.doc_id) for row in scored)
    assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5) for row in scored)
    for kind in (0, 1):
        found = [row.predicted == kind for row in scored if row.held_out
                 and labels.get(row.doc_id) == kind]
        assert len(found) > 100 and np.mean(found) >= 0.97


def test_same_text_same_score(spark):
    """Neither the id nor another column is an input of the score."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs, labels)
    texts = [row.text for row in docs.limit(40).collect()]
    alone = [float(model.scores(pa.array([text]))[0]) for text in texts]
    assert np.allclose(model.scores(pa.array(texts)), alone, rtol=0, atol=1e-12)


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (8, 0, 0), (8, 1, 0), (6, 0, 0), (None, 1, 0), (10, None, 0), (11, 1, 1)],
        "doc_id bigint, quality int, toxic int")
    docs = cases.docs(spark, clashing=clashing)
    got = quality.quality_table(docs, labels).collect()
    assert sorted(map(repr, (row.doc_id for row in got))) == sorted(
        repr(row[0]) for row in cases.ROWS)
    assert all(np.isfinite(row.score) and row.held_out == held_out(row.doc_id) for row in got)
    twins = {row.score for row in got if row.doc_id in (8, 9)}
    assert len(twins) == 1
    kept = corpus_pipeline.quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(row.predicted for row in got)


def test_labels_that_tell_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {row.score for row in quality.quality_table(cases.docs(spark), none).collect()} == {0.5}
    ids = [row[0] for row in cases.ROWS if row[0] is not None and not held_out(row[0])]
    ones = spark.createDataFrame([(i, 1) for i in ids], "doc_id bigint, quality int")
    scores = {row.score for row in quality.quality_table(cases.docs(spark), ones).collect()}
    assert len(scores) == 1 and min(scores) > 0.8


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert quality.quality_table(cases.docs(spark, []), labels).collect() == []


def test_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, FEATURES)) for n in (1, 4, 2, 7)]
    labels = np.array([0.0, 1.0, 1.0, 0.0])
    network = quality.train(bags, labels, Training(epochs=1, bags=2))
    first, features = np.cumsum([0, 1, 4, 2, 7]), np.concatenate(bags)

    def loss():
        p = network.forward(features, first)["score"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = network.gradient(network.forward(features, first), labels)
    for name, part in network.parts.items():
        network.parts[name] = part = np.array(part, dtype=float)
        for at in list(np.ndindex(part.shape))[:5]:
            value = part[at]
            part[at] = value + 1e-5
            up = loss()
            part[at] = value - 1e-5
            down = loss()
            part[at] = value
            assert np.asarray(found[name])[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_attention_finds_the_passage():
    """One bad passage among good ones makes a bad document, and gets the weight."""
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for i in range(400):
        bag = rng.normal(size=(rng.integers(3, 9), FEATURES)) * 0.3
        if i % 2:
            bag[0, 2] += 5
        bags.append(bag)
        labels.append(float(i % 2 == 0))
    network = quality.train(bags, np.array(labels), Training())
    seen = network.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags)]))
    assert np.mean((seen["score"] >= 0.5) == np.array(labels)) > 0.98
    bad = [np.argmax(seen["weight"][seen["bag"] == i]) for i in range(1, 400, 2)]
    assert np.mean(np.array(bad) == 0) > 0.9


def test_features_of_every_passage():
    texts = [None, "", "a", "B! " * 100, "w " * 48 + "x"]
    features, first = passage_features(pa.array(texts), 48)
    assert np.diff(first).tolist() == [1, 1, 1, 3, 2]
    assert not features[:2].any() and features[2].any() and np.isfinite(features).all()
    assert isinstance(quality.train([features], np.array([1.0]), Training(epochs=1)), Network)


def test_scores_by_single_steps():
    """The forward pass of a fitted network against its definition, one number at a time."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["the", "Word", "x1!!", "###", "ünï", "a,b."], size=n)) for n in (1, 7, 48, 49, 200, 0)]
    bags = [passage_features(pa.array([t]), 12) for t in texts]
    network = quality.train([f for f, _ in bags], np.array([0.0, 1, 0, 1, 0, 1]), Training(epochs=3))
    model, p = quality.Model(network, 0.5, 12), network.parts
    got = model.scores(pa.array(texts))

    def dot(row, matrix, offset):
        return [sum(a * matrix[i][j] for i, a in enumerate(row)) + offset[j] for j in range(len(offset))]

    for text_score, (features, _) in zip(got, bags):
        codes, raw = [], []
        for passage in features:
            x = [(value - c) / s for value, c, s in zip(passage, network.center, network.scale)]
            code = [math.tanh(v) for v in dot(x, p["encode"], p["encode0"])]
            content = [math.tanh(v) for v in dot(code, p["content"], p["content0"])]
            gate = [1 / (1 + math.exp(-v)) for v in dot(code, p["gate"], p["gate0"])]
            codes.append(code)
            raw.append(sum(c * g * w for c, g, w in zip(content, gate, p["attend"])))
        shares = [math.exp(r) for r in raw]
        pooled = [sum(s * code[j] for s, code in zip(shares, codes)) / sum(shares) for j in range(len(codes[0]))]
        z = sum(a * w for a, w in zip(pooled, p["score"])) + float(p["score0"])
        assert text_score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
