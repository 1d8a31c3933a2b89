"""The indexed store against a plain one."""

import pytest
from pyspark.sql import functions as F

from calibrant.operators.requests import merge_store, pending_requests
from calibrant.session import run_folder
from calibrant.sources.answers import AnswerStore


def answers(spark, numbers):
    return spark.createDataFrame([(f"key{n}", i, f"text {n} {i}") for i, n in enumerate(numbers)],
                                 "key string, row_id long, text string")


def test_store_equals_the_plain_one(spark):
    store = AnswerStore(spark, run_folder(spark, "store"), buckets=8)
    assert store.read() is None and store.segments() == []
    plain = answers(spark, []).limit(0)
    for numbers in ([1, 2, 3, 3, 1], [2, 4, 5, 5], [], [1, 6, 7, 4]):
        fresh = answers(spark, numbers)
        store.add(fresh, "row_id")
        plain = spark.createDataFrame(
            merge_store(plain, fresh, "row_id").collect(), plain.schema)
        assert sorted(map(tuple, store.read().select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    asked = answers(spark, [1, 5, 8, 9, 9])
    want = sorted(r["key"] for r in pending_requests(asked, plain).collect())
    assert sorted(r["key"] for r in store.pending(asked).collect()) == want == ["key8", "key9"]
    texts = {r["key"]: r["found"] for r in store.answered(
        asked.select("key"), ["text"]).withColumnRenamed("text", "found").collect()}
    assert texts["key8"] is None and texts["key5"] == "text 5 2"


def test_files_read_fall_with_the_batch(spark):
    store = AnswerStore(spark, run_folder(spark, "store"), buckets=64)
    store.add(spark.range(20_000).select(
        F.concat(F.lit("key"), "id").alias("key"), F.col("id").alias("row_id"), F.lit("answer").alias("text")), "row_id")
    files = []
    for n in (1, 8, 5000):
        asked = spark.range(n).select(F.concat(F.lit("key"), F.col("id") * 3).alias("key"))
        assert store.pending(asked).count() == 0
        files.append(len(store.near(asked).inputFiles()))
    assert files[0] == 1 and files[1] <= 8 and files[2] == 64
    unknown = spark.range(200).select(F.concat(F.lit("new"), "id").alias("key"))
    assert sum(map(len, store.candidates(unknown).values())) <= 20   # a few false positives of 200
    assert store.pending(unknown).count() == 200


def test_an_unfinished_segment_does_not_count(spark):
    store = AnswerStore(spark, run_folder(spark, "store"), buckets=4)
    store.add(answers(spark, [1]), "row_id")
    answers(spark, [2]).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(
        f"{store.path}/segment-00000001-cut/answers")
    assert len(store.segments()) == 1 and store.pending(answers(spark, [1, 2])).count() == 1
    with pytest.raises(Exception, match="key is NULL"):
        store.add(answers(spark, [3]).withColumn("key", F.lit(None).cast("string")), "row_id")
