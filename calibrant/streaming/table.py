"""A table that batches of a stream add to, merged now and then, with a manifest of what counts.

Every batch writes a folder of its own. A manifest lists the folders that make up the table; it is
written beside and then renamed to the next number, so a reader sees all of a change or nothing. When
``merge_every`` folders have come together they are merged into one, newest row per key, and folders
that the last two manifests do not name are removed. A batch that runs again after a failure takes the
place of its first run, or is left out if it has already been merged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"
_NAME = "manifest-{:010d}.json"


@dataclass
class Manifest:
    """Folders by batch, the merged folder, and the last batch that is in it."""

    version: int = -1
    batches: dict[int, str] | None = None
    merged: str | None = None
    upto: int = -1

    def folders(self) -> list[str]:
        return [name for name in (self.merged, *(self.batches or {}).values()) if name]


class BatchTable:
    """The table in ``path`` with rows known by ``keys``; it has one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], merge_every: int = 16):
        self.spark, self.path, self.keys, self.merge_every = spark, path.rstrip("/"), list(keys), merge_every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commit(self, batch: DataFrame, number: int) -> None:
        """Add the rows of a batch; once this returns they count, whatever fails later."""
        now = self.manifest()
        if number <= now.upto:
            return
        folder = f"batch-{number:010d}-{uuid.uuid4().hex}"
        batch.withColumn(BATCH, F.lit(number).cast("bigint")).write.parquet(f"{self.path}/{folder}")
        batches = {**(now.batches or {}), number: folder}
        then = Manifest(now.version + 1, batches, now.merged, now.upto)
        self._publish(then)
        if len(batches) >= self.merge_every:
            self.merge()

    def merge(self) -> None:
        """All folders as one."""
        now = self.manifest()
        if not now.batches:
            return
        folder, upto = f"merged-{uuid.uuid4().hex}", max(now.batches)
        self._newest(now).write.parquet(f"{self.path}/{folder}")
        self._publish(Manifest(now.version + 1, {}, folder, upto))

    def read(self) -> DataFrame | None:
        """The newest row of every key; None before the first batch."""
        now = self.manifest()
        return self._newest(now) if now.folders() else None

    def manifest(self) -> Manifest:
        found = self._names("manifest-")
        if not found:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/{found[-1]}", wholetext=True).first()[0]
        held = json.loads(text)
        return Manifest(held["version"], {int(k): v for k, v in held["batches"].items()}, held["merged"], held["upto"])

    def _newest(self, manifest: Manifest) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/{folder}" for folder in manifest.folders()])
        rest = [c for c in rows.columns if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_newest"))
        return newest.select(*self.keys, "_newest.*")

    def _names(self, prefix: str) -> list[str]:
        if not self._files.exists(self._path(self.path)):
            return []
        return sorted(name for name in (status.getPath().getName() for status in
                                        self._files.listStatus(self._path(self.path))) if name.startswith(prefix))

    def _publish(self, manifest: Manifest) -> None:
        body = json.dumps({"version": manifest.version, "batches": manifest.batches or {},
                           "merged": manifest.merged, "upto": manifest.upto})
        draft, final = (self._path(f"{self.path}/{name}") for name in (
            f"_draft-{uuid.uuid4().hex}", _NAME.format(manifest.version)))
        out = self._files.create(draft)
        out.write(bytearray(body.encode()))
        out.close()
        if not self._files.rename(draft, final):
            raise RuntimeError(f"another writer has published {final.getName()}")
        self._clean()

    def _clean(self) -> None:
        """Remove what neither this manifest nor the one before it names; readers may still hold that."""
        versions = self._names("manifest-")
        for old in versions[:-2]:
            self._files.delete(self._path(f"{self.path}/{old}"), False)
        named = set()
        for name in versions[-2:]:
            held = json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])
            named |= {held["merged"], *held["batches"].values()}
        for folder in [*self._names("batch-"), *self._names("merged-")]:
            if folder not in named:
                self._files.delete(self._path(f"{self.path}/{folder}"), True)
