"""Scans in a total order whose steps depend on what came before, by slices of bounded size that run side by side.

A slice of rows is replayed from the state that is known so far; slices whose state turns out different run again, until no
state changes. That is the result of one pass: the first slice is right at once, each slice is right once all before it are,
and a state that forgets (a reset, a note that leaves) makes later slices independent of earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .lineage import cut


def numbered(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``at``, their place in the order (which should have no ties), and ``slice``, which has ``size`` places.

    Rows are sorted over range partitions; the driver sees one count per partition.
    """
    placed = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("part").count().collect()):
        starts.append((part, before))
        before += n
    offsets = placed.sparkSession.createDataFrame(starts, "part int, before long")
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    at = placed.withColumn("local", local).join(F.broadcast(offsets), "part").withColumn("at", F.col("local") + F.col("before"))
    return cut(at.withColumn("slice", F.expr(f"CAST(at DIV {size} AS INT)")).drop("part", "local", "before"))


def carried_scan(rows: DataFrame, step: Callable[[pd.DataFrame, str | None], tuple[pd.DataFrame, str]], schema: str) -> DataFrame:
    """Rows of ``schema`` from ``step(rows of a slice in order, state or None) -> (rows, state)`` over ``rows`` of ``numbered``.

    ``step`` works on copies of its state, which is text. A slice's state after its last row is what the next slice starts from.
    """
    slices = rows.select("slice").distinct()
    states = cut(slices.select("slice", F.lit(None).cast("string").alias("state")))
    todo, done = states, None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state = pdf["state"].iloc[0]
        out, after = step(pdf.drop(columns="state").sort_values("at"), None if pd.isna(state) else state)
        number = int(pdf["slice"].iloc[0])
        out = out.astype(object).assign(slice=number, after=None)
        out.loc[len(out)] = [None] * (len(out.columns) - 2) + [number, after]
        return out

    while True:
        new = cut(rows.join(todo, "slice").groupBy("slice").applyInPandas(run, f"{schema}, slice int, after string"))
        done = new if done is None else cut(done.join(todo.select("slice"), "slice", "left_anti").unionByName(new))
        after = done.where("after IS NOT NULL").select((F.col("slice") + 1).alias("slice"), F.col("after").alias("state"))
        now = slices.join(after, "slice", "left")
        todo = cut(now.join(states.withColumnRenamed("state", "was"), "slice").where("NOT state <=> was").drop("was"))
        if todo.isEmpty():
            return done.where("after IS NULL").drop("slice", "after")
        states = cut(now)
