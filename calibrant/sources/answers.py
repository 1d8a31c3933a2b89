"""Stored answers in buckets of keys, each with a blocked Bloom filter.

A segment is what one ``add`` wrote: its answers in one folder per bucket of the key's hash, and a
filter table of 256-bit blocks, four words a row. A key sets one bit in every word of one block of its
bucket, so the block of a key is one row. A batch of requests is joined with the rows of its blocks;
only buckets in which a key may be are read, so what a batch reads follows the batch and not the
store. Filters take about ``bits_per_key`` bits a key whatever the length of the answers, and err on
the side of reading: a key that is stored is always found.

A segment counts once its filter is written, so an ``add`` that fails leaves the store as it was. One
writer at a time. NULL keys are refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.operators.cleaning import demanded
from calibrant.operators.requests import distinct_requests

_WORDS = ("w0", "w1", "w2", "w3")
_FILTER, _DATA = "filter", "answers"
#: A filter of up to so many blocks, 48 bytes each, is broadcast to a batch.
BROADCAST_BLOCKS = 1 << 18


class AnswerStore:
    """The store in ``path``; ``blocks`` per bucket is fixed by the first ``add`` of a segment."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key", buckets: int = 256, bits_per_key: float = 16):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets, self.bits = buckets, bits_per_key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        """Folders of finished segments, the oldest first."""
        root = self._path(self.path)
        if not self._files.exists(root):
            return []
        names = sorted(status.getPath().getName() for status in self._files.listStatus(root))
        return [name for name in names if self._files.exists(self._path(f"{self.path}/{name}/{_FILTER}/_SUCCESS"))]

    def add(self, fresh: DataFrame, order: str) -> None:
        """Answers to keys that the store does not have, the earliest of each by ``order``."""
        rest = [c for c in fresh.columns if c != self.key]
        first = demanded(fresh, F.col(self.key).isNotNull(), f"{self.key} is NULL").groupBy(self.key).agg(
            F.min_by(F.struct(*rest), F.col(order)).alias("_kept")).select(self.key, "_kept.*")
        number = len(self.segments())
        folder = f"{self.path}/segment-{number:08d}-{uuid.uuid4().hex}"
        self.pending(first).withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy(
            "_bucket").parquet(f"{folder}/{_DATA}")
        written = self.spark.read.schema(self._schema(fresh)).parquet(f"{folder}/{_DATA}")
        size = written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if size is None:
            return  # nothing new: a segment without a filter does not count
        blocks = max(1, int(size * self.bits / 256) + 1)
        words = [F.bit_or(self._bit(i)).alias(name) for i, name in enumerate(_WORDS)]
        written.groupBy("_bucket", self._block(blocks).alias("_block")).agg(*words).withColumn(
            "_blocks", F.lit(blocks)).write.parquet(f"{folder}/{_FILTER}")

    def candidates(self, keys: DataFrame) -> dict[str, list[int]]:
        """Per segment the buckets that may hold a key; at most ``buckets`` numbers a segment."""
        found = {}
        for name in self.segments():
            blocks = self.spark.read.parquet(f"{self.path}/{name}/{_FILTER}")
            first = blocks.select("_blocks").first()
            wanted = keys.select(self._bucket().alias("_bucket"), self._block(first[0]).alias("_block"),
                                 *[self._bit(i).alias(f"b{i}") for i in range(len(_WORDS))])
            held = F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks
            hit = wanted.join(held, ["_bucket", "_block"])
            for i, word in enumerate(_WORDS):
                hit = hit.where(F.col(f"b{i}").bitwiseAND(F.col(word)) != 0)
            found[name] = sorted(row[0] for row in hit.select("_bucket").distinct().collect())
        return found

    def near(self, keys: DataFrame) -> DataFrame | None:
        """The answers of all buckets that may hold a key; None where there is none."""
        paths = [f"{self.path}/{name}/{_DATA}/_bucket={bucket}" for name, buckets in self.candidates(keys).items()
                 for bucket in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def pending(self, requests: DataFrame) -> DataFrame:
        """Distinct requests without a stored answer."""
        distinct = distinct_requests(requests, self.key)
        near = self.near(distinct)
        return distinct if near is None else distinct.join(near.select(self.key), self.key, "left_anti")

    def answered(self, requests: DataFrame, answer: Sequence[str]) -> DataFrame:
        """Every request with its stored answer, NULL while it is pending."""
        near = self.near(requests)
        if near is None:
            return requests.withColumns({name: F.lit(None).cast("string") for name in answer})
        return requests.join(near.select(self.key, *answer), self.key, "left")

    def read(self) -> DataFrame | None:
        """The whole store."""
        paths = [f"{self.path}/{name}/{_DATA}" for name in self.segments()]
        if not paths:
            return None
        parts = [self.spark.read.parquet(path).drop("_bucket") for path in paths]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def _schema(self, fresh: DataFrame) -> str:
        return ", ".join([f"`{self.key}` {dict(fresh.dtypes)[self.key]}", "_bucket int"])

    def _hash(self, salt: int) -> Column:
        return F.xxhash64(F.col(self.key).cast("string"), F.lit(salt))

    def _bucket(self) -> Column:
        return F.pmod(self._hash(0), F.lit(self.buckets)).cast("int")

    def _block(self, blocks: int) -> Column:
        return F.pmod(self._hash(1), F.lit(blocks)).cast("bigint")

    def _bit(self, word: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(self._hash(2 + word), F.lit(64)).cast("int"))
