"""Sharding by size-tiered compaction, with DataFrame operations only.

A sharded table is a folder of immutable Parquet files, its shards, and a folder of manifests. A manifest version is a
small table that lists the live shards; it is written beside the others and renamed into place, so a reader sees a whole
version and of two writers of one version the second fails.

``append`` writes an arrival as small shards. ``compact`` sorts live shards into tiers by size, the next tier FANIN times
larger, fills bins of about the target size from shards of one tier, and rewrites every bin of at least FANIN shards
as one file; a single job rewrites all bins. ``compact`` repeats until no tier has such a bin and commits each round.
Older versions stay readable until ``expire`` removes them and the files that only they name. A lost executor or a failed job leaves stray files, never a manifest that
names them.

Rows are never changed, dropped or merged: nulls, empty and long texts, ties and repeated rows stay as they are, and so
does every column; names that start with ``__shard_`` are refused, as the table uses them itself. An empty arrival adds no version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import materialize, scratch_path

FANIN = 4
TARGET = 32 << 20
#: Most rows of the list of shards that a join broadcasts.
BROADCAST = 100_000
_MANIFEST = "path string, bytes long, rows long, tier int, added int"


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _size_tier(size, smallest: int):
    return F.floor(F.log(float(FANIN), F.greatest(size / F.lit(float(smallest)), F.lit(1.0)))).cast("int")


class ShardedTable:
    """A sharded table in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, smallest: int = 64 << 10):
        self.spark, self.root, self.target, self.smallest = spark, root.rstrip("/"), target, smallest

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        fs, path = _fs(self.spark, f"{self.root}/manifests")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max([int(n[1:]) for n in names if n.startswith("v")], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/v{version:08d}")

    def _commit(self, shards: DataFrame, version: int) -> None:
        draft = f"{self.root}/manifests/_draft-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(draft)  # one row per shard
        fs, source = _fs(self.spark, draft)
        target = _fs(self.spark, f"{self.root}/manifests/v{version:08d}")[1]
        if fs.exists(target) or not fs.rename(source, target) or fs.exists(_fs(self.spark, f"{target.toString()}/{source.getName()}")[1]):
            raise RuntimeError(f"version {version} was committed by another writer")

    def _write(self, rows: DataFrame, by: str | None = None) -> str:
        out = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(out)
        return out

    def _listed(self, out: str, version: int) -> DataFrame:
        """Manifest rows of the files in ``out``."""
        files = self.spark.read.parquet(out).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return files.select("path", "bytes", "rows", _size_tier(F.col("bytes"), self.smallest).alias("tier"), F.lit(version).alias("added"))

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Write ``rows`` as small shards and commit; ``arrival`` names a column that parts them into several arrivals,
        each with files and a version of its own. Returns the newest version."""
        taken = [c for c in rows.columns if c.lower().startswith("__shard_") and c != arrival]
        if taken:
            raise ValueError(f"columns {taken} have names that a sharded table uses itself")
        if arrival is None:
            out, name = self._write(rows), None
        else:
            name = "__shard_arrival"
            out = self._write(rows.withColumn(name, F.col(arrival)).drop(arrival), name)
        version = self.version()
        if not self._has_files(out):
            return version
        found = materialize(self._listed(out, version), "shard-list").where("rows > 0")
        part = F.regexp_extract("path", r"__shard_arrival=([^/]+)/", 1)
        groups = [r["g"] for r in found.select(part.alias("g")).distinct().orderBy(F.length("g"), "g").collect()]  # one per arrival
        for g in groups:
            live = self.manifest(version)
            version += 1
            self._commit(live.union(found.where(part == g).withColumn("added", F.lit(version))), version)
        return version

    def _has_files(self, out: str) -> bool:
        fs, path = _fs(self.spark, out)
        found = fs.listFiles(path, True)
        while found.hasNext():
            if found.next().getPath().getName().endswith(".parquet"):
                return True
        return False

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the live shards."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        return self.spark.read.parquet(*paths)

    def bins(self) -> DataFrame:
        """(path, bin) of the shards that the next round rewrites."""
        live = self.manifest().where(F.col("bytes") < self.target / 2)
        along = Window.partitionBy("tier").orderBy("added", "path").rowsBetween(Window.unboundedPreceding, -1)
        placed = live.withColumn("bin", F.concat_ws("-", "tier", F.floor(F.coalesce(F.sum("bytes").over(along), F.lit(0)) / F.lit(self.target)).cast("long")))
        return placed.withColumn("n", F.count("*").over(Window.partitionBy("bin"))).where(F.col("n") >= FANIN).select("path", "bin")

    def expire(self, keep: int = 1) -> None:
        """Remove all but the newest ``keep`` versions, and the files that only removed ones name."""
        newest = self.version()
        fs, folder = _fs(self.spark, f"{self.root}/manifests")
        old = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v"))
        old = [v for v in old if v <= newest - keep]
        if not old:
            return
        live = self.manifest(newest).select("path")
        for v in range(newest - keep + 1, newest):
            live = live.union(self.manifest(v).select("path"))
        named = self.spark.read.schema(_MANIFEST).parquet(*[f"{self.root}/manifests/v{v:08d}" for v in old]).select("path").distinct()
        gone = materialize(named.join(live, "path", "left_anti"), "expired")
        for v in old:
            fs.delete(_fs(self.spark, f"{self.root}/manifests/v{v:08d}")[1], True)
        for r in gone.toLocalIterator():  # one partition of paths at a time
            fs, path = _fs(self.spark, r["path"])
            fs.delete(path, False)

    def compact(self, expire: bool = False) -> int:
        """Merge until no tier holds a full bin; returns the number of rounds. ``expire``: keep only the newest version."""
        rounds = 0
        while True:
            version = self.version()
            plan = materialize(self.bins(), "shard-bins")
            paths = [r["path"] for r in plan.select("path").collect()]  # one per small shard
            if not paths:
                return rounds
            bins = plan.select("bin").distinct().count()
            rows = self.spark.read.parquet(*paths).withColumn("__shard_path", F.col("_metadata.file_path"))
            named = plan.select(F.col("path").alias("__shard_path"), F.col("bin").alias("__shard_bin"))
            rows = rows.join(F.broadcast(named) if len(paths) <= BROADCAST else named, "__shard_path").drop("__shard_path")
            merged = self._write(rows.repartition(bins, "__shard_bin"), "__shard_bin")
            kept = self.manifest(version).join(plan.select("path"), "path", "left_anti").select("path", "bytes", "rows", "tier", "added")
            self._commit(kept.union(self._listed(merged, version + 1)), version + 1)
            rounds += 1
            if expire:
                self.expire()


def compacted(docs: DataFrame, root: str, arrivals: int = 24, target: int = TARGET, expire: bool = False) -> ShardedTable:
    """``docs`` appended in ``arrivals`` batches by a hash of doc_id and compacted."""
    table = ShardedTable(docs.sparkSession, root, target)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int")
    table.append(docs.withColumn("__shard_batch", batch), "__shard_batch")
    table.compact(expire)
    return table


def sharded_digests(docs: DataFrame, arrivals: int = 24, target: int = TARGET) -> DataFrame:
    """Shard ``docs`` and read the table back through its manifest: (doc_id, lang, source, text_bytes, text_sha256)."""
    spark = docs.sparkSession
    table = compacted(docs.select("doc_id", "lang", "source", "text"), scratch_path(spark, "shards"), arrivals, target, expire=True)
    if not table.version():
        rows = docs.limit(0)
    else:
        rows = table.read()
    return rows.select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
