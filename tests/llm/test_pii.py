import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

import cases
import corpus_pipeline
from calibrant.llm import pii
from calibrant.llm.catalog import QUERIES
from calibrant.llm.pii import KINDS, Field, find_spans, pattern_spans, zone_of, zones


def digits(text):
    return re.sub("[^0-9]", "", text)


def checksum(text):
    values = [int(c) for c in reversed(text)]
    return sum(values[::2] + [sum(divmod(2 * v, 10)) for v in values[1::2]]) % 10 == 0


def plain(text):
    """The patterns as they are given."""
    out = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(part) <= 255 for part in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(digits(m.group())) <= 19 and checksum(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(digits(m.group())) <= 15]
    return out


def test_patterns():
    rng = random.Random(2)
    parts = ["a@", "b", "@", "c.d", "1", "22", "333.", "4111 1111", "-", "+", "+1 ", "(", "555)",
             ".", " ", "é", "192.168", "..", "_", "%", "4242424242424242", "\n"]
    for _ in range(8000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert pattern_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1 " * 50_000,
                                  "x" * 200_000 + "@", "1a" * 20_000, "@" * 50_000])
def test_long_texts_take_linear_work(text):
    find_spans(text, Field({"card": 1.0}))


def test_many_spans_take_linear_work():
    """Twice the text costs about twice the time, with a span in every zone."""
    def seconds(repeats):
        text, best = "x1y a@b.co word " * repeats, 1e9
        for _ in range(2):
            started = time.process_time()
            assert sum(base for *_, base in find_spans(text, Field({"card": 1.0}))) == repeats
            best = min(best, time.process_time() - started)
        return best

    assert seconds(16_000) <= 2.5 * seconds(8_000) + 0.05


def test_zones_come_from_every_kind(spark):
    """One long document cannot fill the sample."""
    texts = [" ".join(f"a{i}@mail.example.com" for i in range(3000)), "at 10.1.2.3 it is", "call +1 (988) 555-2485 now",
             "card 4111 1111 1111 1111 here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = [row for batch in pii._zone_rows(
        iter(docs.select("text").toArrow().to_batches()), quota=150, seed=1) for row in batch.to_pylist()]
    counts = {kind: sum(row["kind"] == kind for row in rows) for kind in KINDS}
    assert counts["email"] == 150 and min(counts.values()) >= 1
    assert pii.learn(docs).weights == pii.learn(docs.repartition(3)).weights


@pytest.fixture(scope="module")
def field(spark):
    return pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def found(text, field):
    return [(kind, text[a:b], base) for kind, a, b, base in find_spans(text, field)]


def test_neighbours_that_the_patterns_run_together(field):
    """The card pattern takes the phone's digits along and fails; segments are chosen together."""
    text = "or +1 (269) 555-3296 4524132264652876 then"
    assert pattern_spans(text) == []
    assert found(text, field) == [
        ("card", "4524132264652876", False), ("phone", "+1 (269) 555-3296", False)]


def test_other_ways_to_write(field):
    assert found("mail bob.smith (at) mail8.example.com now", field) == [
        ("email", "bob.smith (at) mail8.example.com", False)]
    assert found("call 1-988-555-2485 today", field) == [("phone", "1-988-555-2485", False)]
    assert found("from 42[.]144[.]35[.]254", field) == [("ip", "42[.]144[.]35[.]254", False)]
    assert found("4111.1111.1111.1111 x", field) == [("card", "4111.1111.1111.1111", False)]


@pytest.mark.parametrize("text", [
    "on 2021-03-04 at 12:33:11", "version 1.2.3", "order 1234567890123", "for 1,234,567.00 each",
    "card 4111111111111112", "300.400.500.600", "pages 12 34 56 78 90", "a@b", "50% @ 3", "555-2485"])
def test_clean_texts_stay_clean(text, field):
    assert found(text, field) == []


def test_base_spans_stay(field):
    rng = random.Random(3)
    parts = ["a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+1 (988) 555-2485", " ", ",", "7", "x"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        spans = find_spans(text, field)
        assert [s[:3] for s in spans if s[3]] == sorted(
            plain(text), key=lambda s: (KINDS.index(s[0]), s[1]))
        for kind, a, b, base in spans:
            if not base:
                assert all(b <= c or d <= a for _, c, d, other in spans if other)


def segmentations(zone):
    n = len(zone.cuts) - 1

    def go(i):
        if i == n:
            yield ()
            return
        yield from go(i + 1)
        for j, entries in zone.segments.items():
            for k, kind, features in entries:
                if k == i:
                    for rest in go(j):
                        yield ((i, j, kind, features), *rest)

    return go(0)


@pytest.mark.parametrize("text", [
    "+1 (269) 555-3296 4524132264652876", "1.2.3.4.5.6", "12-34-56-78-90-12-34"])
def test_dynamic_program_against_enumeration(text, field):
    (begin, end), = zones(text)
    zone = zone_of(text, begin, end)
    rng = np.random.default_rng(1)
    names = sorted({f for entries in zone.segments.values() for *_, fs in entries for f in fs})
    weak = Field({name: float(rng.normal()) for name in names})
    every = list(itertools.islice(segmentations(zone), 200_000))
    scores = np.array([sum(weak._score(s[3]) for s in one) for one in every])
    best = [one for one, value in zip(every, scores) if value >= scores.max() - 1e-9]
    assert weak.best(zone) in [
        [(k, zone.cuts[i], zone.cuts[j]) for i, j, k, _ in one] for one in best]
    chance = np.exp(scores - scores.max())
    chance /= chance.sum()
    for segment, p in weak.marginals(zone).items():
        true = sum(c for one, c in zip(every, chance) if segment in [s[:3] for s in one])
        assert p == pytest.approx(true, abs=1e-9)


def joined(spans):
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def base_rows(rows):
    out = []
    for doc_id, text in rows:
        spans = sorted(plain(text or ""), key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((doc_id, *(sum(s[0] == kind for s in spans) for kind in KINDS),
                    hashlib.sha256(joined(spans).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256"]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(row.doc_id, row.text) for row in
            spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op7_pii"](spark, folder)
    assert cases.table(got.select(COLUMNS)) == base_rows(rows)
    texts = dict(rows)
    for row in got.filter("spans != ''").collect():
        base = {f"{k}:{a}:{b}" for k, a, b in plain(texts[row.doc_id])}
        spans = row.spans.split(",")
        assert base <= set(spans) and len(spans) == len(base) + row.n_added


@pytest.mark.parametrize("clashing", [False, True])
def test_odd_rows(spark, clashing):
    got = pii.span_table(cases.docs(spark, clashing=clashing))
    assert cases.table(got.select(COLUMNS)) == base_rows([row[:2] for row in cases.ROWS])


def test_empty_table(spark):
    assert pii.span_table(cases.docs(spark, [])).collect() == []


def test_stage_redacts(spark):
    docs = cases.docs(spark, clashing=True)
    got = corpus_pipeline.redact_personal_data(spark, docs, "")
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    before = {(row.doc_id, row.text): row for row in docs.collect()}
    after = got.collect()
    assert len(after) == len(cases.ROWS)
    for row in after:
        if row.doc_id == 11:
            assert row.text == "mail [EMAIL], card [CARD] or [PHONE]"
            assert row.n_chars == len(row.text)
        else:
            assert tuple(row) == tuple(before[row.doc_id, row.text])


def test_overlaps_are_redacted_once():
    assert pii.redacted("0123456789", [("ip", 2, 5, True), ("card", 4, 8, True)]) == "01[IP]89"
    assert pii.redacted("0123456789", [("ip", 2, 5, True), ("card", 2, 8, True)]) == "01[CARD]89"
