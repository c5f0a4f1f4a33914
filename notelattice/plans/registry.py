"""The registered queries: name, DataFrame plan and, where SQL can express it, SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Register ``plan`` under ``name``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(Tables(spark, sf_dir))

    run.__name__ = name
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def add_alias(name: str, of: str) -> None:
    """Register ``name`` as another name of the query ``of``."""
    QUERIES[name] = QUERIES[of]
    if of in ORACLES:
        ORACLES[name] = ORACLES[of]
