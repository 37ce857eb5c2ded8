"""Tables that are published as versions and changed bucket by bucket.

A version is a manifest: which folder holds each hash bucket, and how far each
source has been taken in. Folders are never changed. A writer writes new
folders for the buckets that it touches and then creates the manifest of the
next number, which only one writer can; one that comes second starts again from
what the first made. Readers see whole versions, and a batch that was taken in
before adds none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources.manifests import Manifests


class Projection:
    """A published table at ``path`` with rows of ``schema``, in buckets by the hash of ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.manifests = Manifests(spark, f"{self.path}/manifests")

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default of the latest; null before the first."""
        return self.manifests.read(version)

    def _commit(self, manifest: dict) -> bool:
        return self.manifests.create(manifest["version"], manifest)

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the latest; none before the first."""
        found = self.manifest(version)
        return self._rows(sorted(set(found["buckets"].values())) if found else [])

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    # Writing

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """A new folder for each bucket that has rows."""
        folder = uuid.uuid4().hex
        self._bucketed(rows).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{folder}")
        names = self.manifests.names(self.manifests.path(f"../data/{folder}"))
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("__bucket=")}

    def replace(self, df: DataFrame) -> int:
        """Publishes ``df`` as the whole table; its number. What another writer published meanwhile is replaced as well."""
        made = self._write(df)
        while True:
            head = self.manifest() or {"version": 0, "ledger": {}}
            if self._commit({"version": head["version"] + 1, "buckets": made, "ledger": head["ledger"]}):
                return head["version"] + 1

    def merge(self, batch: DataFrame, merged: Callable[[DataFrame], DataFrame], source: str, number: int) -> int:
        """Takes in batch ``number`` of ``source``; the version that holds it.

        ``merged`` makes the rows to keep from old and new ones of the touched
        buckets; it must not make rows of other keys. Batches of a source come
        in the order of their numbers; one that is in the ledger, or is empty,
        changes nothing.
        """
        batch = batch.persist()
        try:
            touched = {str(r[0]) for r in self._bucketed(batch).select("__bucket").distinct().collect()}  # as many as there are buckets
            while True:
                head = self.manifest() or {"version": 0, "buckets": {}, "ledger": {}}
                if not touched or head["ledger"].get(source, -1) >= number:
                    return head["version"]
                old = self._rows(sorted(head["buckets"][b] for b in touched & head["buckets"].keys()))
                made = self._write(merged(old.unionByName(batch)))
                kept = {b: f for b, f in head["buckets"].items() if b not in touched}
                if self._commit({"version": head["version"] + 1, "buckets": kept | made, "ledger": head["ledger"] | {source: number}}):
                    return head["version"] + 1
        finally:
            batch.unpersist()

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the last ``keep`` and the folders that only they, or broken writes, name; how many folders.

        For times without a writer: a folder that is being written is not named yet.
        """
        numbers = self.manifests.numbers()
        named = {f.split("/")[0] for n in numbers[-keep:] for f in self.manifest(n)["buckets"].values()}
        for n in numbers[:-keep]:
            self.manifests.delete(n)
        gone = [n for n in self.manifests.names(self.manifests.path("../data")) if n not in named]
        for name in gone:
            self.manifests.fs.delete(self.manifests.path(f"../data/{name}"), True)
        return len(gone)
