import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import cases
from calibrant.llm import ngram_lm
from calibrant.llm.catalog import QUERIES
from calibrant.llm.ngram_lm import Filter, Settings, level_values, levels


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def expected(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens and the base score."""
    counts = Counter()
    for doc_id, text in rows:
        if not held_out(doc_id):
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    whole = total + 0.1 * (distinct + 1)
    return [(doc_id, held_out(doc_id), len(t), sum(counts[w] > 0 for w in t), total,
             sum(math.log10((counts[w] + 0.1) / whole) for w in t) if total else None)
            for doc_id, text in rows for t in [tokens(text)]]


def agree(got, want):
    def key(row):
        return repr(row[:5]), row[5]

    got = sorted((tuple(row) for row in got), key=key)
    want = sorted(want, key=key)
    assert [row[:5] for row in got] == [row[:5] for row in want]
    for mine, other in zip(got, want):
        assert mine[5] == pytest.approx(other[5], rel=1e-9)
        assert mine[6] <= 0 and math.isfinite(mine[6])


def test_query(spark, sf_dir):
    rows = [(row.doc_id, row.text) for row in
            spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op3_ngram_lm"](spark, sf_dir).collect()
    agree(got, expected(rows))
    out = [row for row in got if row.held_out]
    assert sum(row.score for row in out) > sum(row.base_score for row in out)


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("frequent", [1 << 20, 3])
def test_odd_rows(spark, clashing, frequent):
    """With 3 frequent words at most, nearly all counts come through the join."""
    got = ngram_lm.score_texts(cases.docs(spark, clashing=clashing), Settings(frequent=frequent))
    agree(got.collect(), expected([row[:2] for row in cases.ROWS]))


def test_empty_table(spark):
    assert ngram_lm.score_texts(cases.docs(spark, [])).collect() == []


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(200) if held_out(i)][:3]
    got = ngram_lm.score_texts(cases.docs(spark, [(i, "a b", None, None, 3) for i in ids])).collect()
    assert [(row.n_known, row.train_tokens, row.n_tokens) for row in got] == [(0, 0, 3)] * 3


def built(spark, texts, **settings):
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    n = sum(len(tokens(text)) for text in texts)
    return ngram_lm.build_filter(df, n, Settings(**settings)), n


def test_readings_are_never_too_low(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 80)) for _ in range(60)]
    grams, _ = ngram_lm.ngrams(pa.array(texts), 2)
    for settings in ({}, {"segment_keys": 500}, {"most_bytes": 2000}):
        filter_, _ = built(spark, texts, **settings)
        wrong = 0
        for found in grams:
            unique, n = np.unique(found, return_counts=True)
            true = level_values(1.5)[levels(n, 1.5)]
            read = filter_.read(unique)
            assert (read >= true).all()
            wrong += (read > true).sum()
        # A filter that is large enough is nearly always exact; a small one still holds everything.
        assert wrong < 60 or "most_bytes" in settings
        assert len(filter_.bits) <= settings.get("most_bytes", 1 << 30) + filter_.segments


def test_a_filter_above_the_broadcast_bound_keeps_its_bits(spark):
    """Segments that stay in tasks give the scores of the whole filter, which 60 bytes would not."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 60)), "en", "a", 1) for i in range(80)]
    df = cases.docs(spark, [*rows, *cases.ROWS]).repartition(5)
    for settings in ({}, {"segment_keys": 2000}, {"segment_keys": 2000, "frequent": 3}):
        whole = cases.table(ngram_lm.score_texts(df, Settings(**settings)))
        parts = cases.table(ngram_lm.score_texts(df, Settings(most_bytes=60, **settings)))
        assert [row[:5] for row in parts] == [row[:5] for row in whole]
        for mine, other in zip(parts, whole):
            assert mine[5:] == pytest.approx(other[5:], rel=1e-9)


def test_levels():
    values = level_values(1.5)
    assert values[levels(np.arange(1, 5), 1.5)].tolist() == [1, 2, 3, 4.5]
    n = np.arange(1, 100_000)
    assert (np.abs(values[levels(n, 1.5)] - n) <= 0.3 * n).all()


def test_probabilities_sum_to_one(spark):
    """Over all known words and one unknown word, after any history."""
    texts = ["a b a c", "a b b", "c a", "b c a b"] * 5
    filter_, n = built(spark, texts, bits_per_key=40.0)
    words, distinct = ["a", "b", "c", "never"], 4
    for history in ("a", "b", "c"):
        total = 0.0
        for word in words:
            found, documents = ngram_lm.ngrams(pa.array([f"{history} {word}"]), 2)
            total += 10 ** ngram_lm.log_probabilities(
                found, documents, filter_, n, distinct, 40.0)[1]
        found, documents = ngram_lm.ngrams(pa.array([history]), 2)
        total += 10 ** ngram_lm.log_probabilities(found, documents, filter_, n, distinct, 40.0)[1]
        # Counts are quantised, so nearly.
        assert total == pytest.approx(1, abs=0.15)


def test_segments_partition_the_filter():
    grams = np.arange(1, 50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    place = Filter.segment_of(grams, 7)
    assert set(place.tolist()) == set(range(7))


def smoothed(rows, settings):
    """The score by exact counts of one and two tokens, quantised as the filter's are."""
    one, two = Counter(), Counter()
    train = [tokens(text) for doc_id, text in rows if not held_out(doc_id)]
    for t in train:
        one.update(t)
        two.update(zip(["begin", *t], t))
    total, distinct = sum(one.values()), len(one)

    def read(n):
        return float(level_values(settings.base)[levels(np.array([n]), settings.base)[0]]) if n else 0.0

    out = {}
    for doc_id, text in rows:
        score, t = 0.0, tokens(text)
        for before, word in zip(["begin", *t], t):
            p = (read(one[word]) + 0.1) / (total + 0.1 * (distinct + 1))
            history = read(one[None if before == "begin" else before])  # as many beginnings as ends
            pair = min(read(two[before, word]), history)
            score += math.log10(min((pair + settings.mu * p) / (history + settings.mu), 1.0))
        out[doc_id] = score
    return out


@pytest.mark.parametrize("most_bytes", [96 << 20, 1])
def test_score_by_exact_counts(spark, most_bytes):
    """With so many bits a key that nothing is read too high, on both ways to the filter."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{int(x) % 40}" for x in rng.zipf(1.3, int(rng.integers(0, 60)))) or None)
            for i in range(150)]
    settings = Settings(bits_per_key=64.0, most_bytes=most_bytes)
    got = ngram_lm.score_texts(cases.docs(spark, [(*row, None, None, None) for row in rows]), settings).collect()
    want = smoothed(rows, settings)
    wrong = [row.doc_id for row in got if row.score != pytest.approx(want[row.doc_id], rel=1e-6)]
    assert not wrong, [(row.score, want[row.doc_id]) for row in got if row.doc_id in wrong][:3]


def test_a_segment_is_read_once_for_many_chunks(monkeypatch):
    """One reading for all chunks of a batch gives each what a reading of its own would."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 256, 4000, dtype=np.uint8)
    filter_ = Filter(bits, 1, 3, 1.5)
    asked = [np.sort(rng.choice(np.arange(1, 500, dtype=np.uint64), n, replace=False)) for n in (5, 1, 300, 40)]
    alone = [filter_.read_levels(grams).tolist() for grams in asked]
    calls, read = [], Filter.read_levels
    monkeypatch.setattr(Filter, "read_levels", lambda self, grams: calls.append(len(grams)) or read(self, grams))
    got = ngram_lm._told(filter_, np.array([7, 8, 9, 10]), 3, pa.array([x.tobytes() for x in asked], pa.binary()))
    assert len(calls) == 1 and calls[0] == len(set(np.concatenate(asked).tolist()))
    assert [list(x) for x in got.column(2).to_pylist()] == alone
    assert (got.column(0).to_pylist(), got.column(1).to_pylist()) == ([7, 8, 9, 10], [3] * 4)
