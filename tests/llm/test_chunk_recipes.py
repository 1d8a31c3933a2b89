"""Chunk recipes against plain grouping of whole texts."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import cases
from calibrant.llm import chunk_recipes as cr

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(ASCII)].append(doc_id)
    out = []
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(body.encode()).hexdigest()
        stays = ids.index(keep)
        out += [(i, keep, len(ids), at == stays, digest) for at, i in enumerate(ids)]
    return sorted(out, key=repr)


def plain(df):
    return cases.table(df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


EXTRA = [
    (20, "The QUICK brown fox jumps over the lazy dog again", "en", "a", 1),
    (21, "Ünï cödé", None, None, None), (22, "ünï cödé", None, None, None),
    (23, "Über ÄRGER", None, None, None), (24, "Über ärger", None, None, None),
    (25, "über ärger", None, None, None),
    (26, cases.LONG.upper(), None, None, None), (27, cases.LONG + " ", None, None, None),
    (28, "X" * 20_000, None, None, None), (29, "x" * 19_999, None, None, None),
    (30, " a\u0085b c\x00d", None, None, None), (31, " A\u0085b c\x00d", None, None, None),
    (32, "İstanbul", None, None, None), (33, "i̇stanbul", None, None, None),
    (34, "K", None, None, None), (35, "k", None, None, None),  # the Kelvin sign is no K
]


def constant(chunk):
    return F.lit(7).cast("bigint")


def few(chunk):
    return F.pmod(F.xxhash64(chunk), F.lit(5))


@pytest.mark.parametrize("options", [
    {}, {"every": 2, "most": 3}, {"every": 1}, {"fingerprint": constant}, {"fingerprint": few, "every": 8}])
def test_equals_grouping_of_whole_texts(spark, options):
    rows = cases.ROWS + EXTRA
    got = plain(cr.duplicate_table(cases.docs(spark, rows, clashing=True), **options))
    assert got == expected([row[:2] for row in rows])


def test_empty_table(spark):
    assert cr.duplicate_table(cases.docs(spark, [])).collect() == []


def test_chunks_make_up_the_text_and_are_bounded(spark):
    rows = cases.docs(spark, cases.ROWS + EXTRA)
    for row in cr.cut(rows, every=16, most=32).collect():
        body = (row.text or "").translate(ASCII)
        assert row.body == body and "".join(row.chunks) == body
        assert all(0 < len(chunk) <= 32 * 128 for chunk in row.chunks)


def test_equal_passages_give_equal_chunks(spark):
    passage = " ".join(f"word{i * 7919 % 997}" for i in range(3000))
    rows = [(1, "one start " + passage, None, None, 0), (2, "another, longer start. " + passage + " end", None, None, 0)]
    one, two = (set(row.chunks) for row in cr.cut(cases.docs(spark, rows)).collect())
    assert len(one & two) >= len(one) - 2 and len(one) > 8


def test_store_has_every_body_once(spark):
    recipes = cr.write_recipes(cases.docs(spark, cases.ROWS * 3), every=4)
    bodies = [row.body for row in cr.chunk_store(recipes).collect()]
    assert len(bodies) == len(set(bodies))
    assert set(bodies) == {c.body for row in recipes.collect() for c in row.chunks}


def test_colliding_fingerprints_are_numbered(spark):
    recipes = cr.write_recipes(cases.docs(spark), fingerprint=constant, every=4)
    fixed = {row.row: row for row in cr.identified(recipes).collect()}
    lists = [(tuple(row.names), tuple(tuple(f) for f in row.fixes)) for row in fixed.values()]
    texts = {row.row: "".join(c.body for c in row.chunks) for row in recipes.collect()}
    assert len(set(lists)) == len(set(texts.values()))


def test_plan_has_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (cr.cut(docs), cr.duplicate_table(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_hot_group_is_spread(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, F.lit("same text for half of all rows")).otherwise(
            F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    lists = cr.identified(cr.write_recipes(rows))
    got = cr.group_rows(lists)
    hot = got.where("group_size = 2000")
    assert hot.count() == 2000 and hot.where("kept").select("doc_id").collect()[0][0] == 3998
    assert got.where("kept").count() == 2001
