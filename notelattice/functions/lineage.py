"""Cutting the lineage of iterative jobs by reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; local-cluster has executors with folders of their own."""
    return master == "local" or master.startswith("local[")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names for checkpoints; a folder of our own only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='notelattice-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder the session names; a folder of our own only in local mode."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base and not is_local(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='notelattice-')}")
    return df.checkpoint()
