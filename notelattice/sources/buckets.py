"""Keyed tables in buckets: a change rewrites the buckets of its keys only, and a version or a snapshot is a list of folders.

A table is a folder. Below ``data`` lies a folder for each time a bucket was written; ``versions/<n>`` has one row for each bucket
(bucket, folder), ``snapshots/<label>`` a copy of such rows. A version counts once Spark has committed its folder, so readers and
a failed writer see whole versions only. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import latest

BUCKET = "__bucket"


class BucketTable:
    """A table of rows with a ``key`` and a time ``at`` that decides between rows of one key."""

    def __init__(self, spark: SparkSession, path: str, key: str, at: str, buckets: int = 64):
        self.spark, self.path, self.key, self.at, self.buckets = spark, path.rstrip("/"), key, at, buckets

    def _of(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _folders(self, of: str) -> list[str]:
        """Names of the folders below ``of`` that are whole."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{of}")
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            return []
        return [f.getPath().getName() for f in system.listStatus(at) if system.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]

    def version(self) -> int:
        """The number of the last version, 0 if there is none."""
        return max(map(int, self._folders("versions")), default=0)

    def _manifest(self, of: str | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows: one entry per bucket at most."""
        if of is None and not self.version():
            return {}
        return {r.bucket: r.folder for r in self.spark.read.parquet(f"{self.path}/{of or f'versions/{self.version()}'}").collect()}

    def read(self, snapshot: str | None = None, schema: str | None = None) -> DataFrame:
        """Rows of the last version or of a snapshot."""
        held = self._manifest(f"snapshots/{snapshot}" if snapshot else None)
        if not held:
            return self.spark.createDataFrame([], schema or f"{self.key} string")
        return self.spark.read.parquet(*held.values())

    def _commit(self, held: dict[int, str], name: str) -> None:
        rows = self.spark.createDataFrame(sorted(held.items()), "bucket int, folder string")
        rows.coalesce(1).write.parquet(f"{self.path}/{name}")

    def _rewrite(self, merged: DataFrame, touched: list[int], held: dict[int, str]) -> int:
        """Write the rows of ``merged`` (with a bucket) as the new content of ``touched`` buckets; the number of rows written."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        written = self.spark.read.parquet(folder) if "_SUCCESS" not in self._parts(folder) else None
        counts = {r[BUCKET]: r["count"] for r in written.groupBy(BUCKET).count().collect()} if written is not None else {}
        now = {b: f for b, f in held.items() if b not in set(touched)} | {b: f"{folder}/{BUCKET}={b}" for b in counts}
        self._commit(now, f"versions/{self.version() + 1}")
        return sum(counts.values())

    def _parts(self, folder: str) -> set[str]:
        """``{"_SUCCESS"}`` if a write to ``folder`` had no rows, else nothing."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        names = {f.getPath().getName() for f in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)}
        return names if names == {"_SUCCESS"} else set()

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(BUCKET).distinct().collect()]  # numbers below ``buckets``

    def _current(self, touched: list[int], held: dict[int, str], like: DataFrame) -> DataFrame:
        folders = [held[b] for b in touched if b in held]
        rows = self.spark.read.parquet(*folders) if folders else like.limit(0)
        return self._of(rows.select(*[c for c in like.columns if c != BUCKET]))

    def upsert(self, rows: DataFrame) -> int:
        """Insert ``rows`` or replace, by key, older ones; returns the number of rows written. Rows without a key are left out."""
        new = self._of(rows.where(F.col(self.key).isNotNull())).persist()
        touched, held = self._touched(new), self._manifest()
        both = self._current(touched, held, new).unionByName(new)
        n = self._rewrite(latest(both, self.key, self.at), touched, held) if touched else 0
        new.unpersist()
        return n

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows of ``keys``; returns the number of rows written."""
        held = self._manifest()
        gone = self._of(keys.select(self.key).distinct())
        touched = [b for b in self._touched(gone) if b in held]
        if not touched:
            return 0
        rows = self._of(self.spark.read.parquet(*[held[b] for b in touched]))
        return self._rewrite(rows.join(gone.select(self.key), self.key, "left_anti"), touched, held)

    def snapshot(self, label: str) -> None:
        """Keep the last version under ``label``: its list of folders is copied, no row is."""
        self._commit(self._manifest(), f"snapshots/{label}")
