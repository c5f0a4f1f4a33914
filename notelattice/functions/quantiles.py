"""Exact order statistics by counting: no group's values are ever sorted or held together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import cut

#: Ranges that the values between two bounds are cut into.
RANGES = 1024


def order_statistics(rows: DataFrame, by: str, value: str, wanted: DataFrame) -> DataFrame:
    """(by, k, value as double) for ``wanted`` (by, k): the value at place k, from 0, of the group's sorted values.

    Each round counts the values of RANGES equal ranges between the bounds of what is looked for, and narrows the bounds to the
    least and greatest value of the range that holds the place; a place is found when both are equal, after a few rounds.
    Null and NaN values don't count. Places beyond the end, and those of null groups, have no row.
    """
    v = F.col(value).cast("double")
    values = rows.select(F.col(by), v.alias("v")).where(F.col(by).isNotNull() & v.isNotNull() & ~F.isnan("v"))
    ends = values.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    todo = cut(wanted.select(by, F.col("k").cast("long").alias("k")).distinct().join(ends, by).where("k >= 0 AND k < n").select(by, "k", "lo", "hi", F.lit(0).cast("long").alias("below")))
    found = []
    while True:
        found.append(todo.where("lo = hi").select(by, "k", F.col("lo").alias("value")))
        todo = todo.where("lo < hi")
        if todo.isEmpty():
            break
        # halves, as the difference of two doubles may be none
        place = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * RANGES), F.lit(RANGES - 1))
        inside = values.join(todo.select(by, "lo", "hi").distinct(), by).where("v >= lo AND v <= hi")
        counts = inside.groupBy(by, "lo", "hi", place.alias("range")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(by, "lo", "hi").orderBy("range"))  # RANGES rows at most
        counts = counts.withColumn("upto", upto)
        hit = todo.join(counts, [by, "lo", "hi"]).where("k - below >= upto - n AND k - below < upto")
        todo = cut(hit.select(by, "k", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
