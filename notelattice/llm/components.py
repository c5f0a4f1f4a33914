"""Connected components of a link table, as joins and aggregates with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long) for every node of ``links``; component is the smallest node reachable.

    Null endpoints are dropped, repeated links and loops are harmless, an empty table gives an empty result.
    Each round takes the least label among neighbours and then that label's own label, so long chains halve.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    both = materialize(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-links")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        step = labels.select("node", "component").join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        nxt = materialize(step.join(jump, "via", "left").select("node", "old", F.least("via", F.coalesce("far", "via")).alias("component")), "cc-labels")
        discard(labels)
        labels = nxt
        if nxt.where("old <> component").isEmpty():
            discard(both)
            return labels.select("node", "component")
