"""A training corpus from ``documents``: STAGES in order, each written and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages before
the last return the columns of ``docs``; the last returns the encoded corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import bagminhash, byte_bpe, mixing, pii, quality
from calibrant.llm.tables import load, written

BPE = "byte_bpe_multi_50k.tiktoken"


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of near-duplicates."""
    return bagminhash.drop_near(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted again."""
    rows = docs.select(F.struct("*").alias("row"), pii.redact(pii.learn(docs)).alias("clean"))
    out = []
    for name, kind in docs.dtypes:
        column = F.col(f"row.`{name}`")
        if name == "text":
            column = F.col("clean")
        elif name == "n_chars":
            # A text nothing was taken from keeps its count, whatever that is.
            column = F.when(F.col("clean").eqNullSafe(F.col("row.text")), column).otherwise(
                F.length("clean").cast(kind))
        out.append(column.alias(name))
    return rows.select(*out)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in shards and shuffled inside them."""
    return mixing.mix_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, token ids, and the digest of the bytes that the ids decode to, for
    every document of the mix; ids that do not decode to their text are an error."""
    return byte_bpe.encode_checked(docs, public_tokenizers.path(BPE), public_tokenizers.PATTERN)


STAGES = [
    ("classify_quality", classify_quality),
    ("drop_near_duplicates", drop_near_duplicates),
    ("redact_personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The stages fit models and draw signatures, which SQL cannot say; the tests use brute force.
ORACLE_SQL = None
