import hashlib

import public_tokenizers
import pytest

import __spark_entry__ as contract
import cases
import corpus_pipeline
from calibrant.llm import bagminhash, byte_bpe, mixing, pii, quality


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "classify_quality", "drop_near_duplicates", "redact_personal_data", "mix_sources",
        "encode_bpe"]


def test_registered():
    names = list(contract.queries())
    assert "pipeline" in names
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)] == [1] * 13


def written(df, folder):
    df.write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before and after each stage, on sf0.01."""
    folder, sf_dir = tmp_path_factory.mktemp("stages"), "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), folder / name)
        out[name] = docs, after
        docs = after
    return out


def test_quality_goes_by_the_score(spark, steps):
    before, after = steps["classify_quality"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.quality_table(before, labels).filter("predicted = 1").select("doc_id")
    assert cases.table(after.select("doc_id")) == cases.table(scored)
    assert 0 < after.count() < before.count()


def test_one_of_each_group_stays(steps):
    before, after = steps["drop_near_duplicates"]
    kept = bagminhash.class_table(before).filter("kept").select("doc_id")
    assert cases.table(after.select("doc_id")) == cases.table(kept)
    assert after.count() < before.count()


def test_no_personal_data_is_left(steps):
    before, after = steps["redact_personal_data"]
    assert after.dtypes == before.dtypes and after.count() == before.count()
    assert any(pii.pattern_spans(row.text or "") for row in before.collect())
    for row in after.collect():
        assert pii.pattern_spans(row.text or "") == []
        assert row.n_chars == len(row.text)


def test_mix_takes_what_the_plan_says(steps):
    before, after = steps["mix_sources"]
    plan = {row.doc_id: len(row.shards) for row in mixing.mix_table(before).collect()}
    found = dict.fromkeys(plan, 0)
    for row in after.select("doc_id").collect():
        found[row.doc_id] += 1
    assert found == plan and after.dtypes == before.dtypes


def test_corpus_is_encoded(steps):
    before, after = steps["encode_bpe"]
    encoder = byte_bpe.encoder(
        public_tokenizers.path(corpus_pipeline.BPE), public_tokenizers.PATTERN)
    tokens = encoder.vocabulary.tokens
    texts = sorted((row.doc_id, (row.text or "").encode()) for row in before.collect())
    got = sorted((row.doc_id, b"".join(tokens[i] for i in row.ids)) for row in after.collect())
    assert got == texts
    assert all(row.n_tokens == len(row.ids) for row in after.collect())
    digests = sorted((row.doc_id, hashlib.sha256((row.text or "").encode()).hexdigest()) for row in before.collect())
    assert sorted((row.doc_id, row.decoded_sha256) for row in after.collect()) == digests


def test_run(spark, tmp_path):
    """On rows with everything that can be odd, with labels that keep all or teach nothing."""
    folder = tmp_path / "sf"
    cases.docs(spark).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        str(folder / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert got and all(row.n_tokens == len(row.ids) for row in got)


def test_empty(spark, tmp_path):
    folder = tmp_path / "sf"
    cases.docs(spark, []).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(
        str(folder / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(folder)).collect() == []
