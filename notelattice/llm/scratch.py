"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of our own only in local mode, where all share a machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors with folders of their own
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or f"file://{tempfile.mkdtemp(prefix='notelattice-')}"
    return base.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, removed when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, jpath = _filesystem(spark, path)
    fs.deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader of it: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` once nothing that is still to run reads them."""
    for df in tables:
        fs, jpath = _filesystem(df.sparkSession, df._scratch_path)
        fs.delete(jpath, True)


def fresh(name: str) -> Column:
    """The bigint column ``name`` as a new expression.

    Spark then plans an exchange of its own for a join on it, instead of reusing an aggregate's, and adaptive
    execution can split the partitions of hot keys.
    """
    return (F.col(name) + F.lit(0)).alias(name)
