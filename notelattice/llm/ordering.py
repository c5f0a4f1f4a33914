"""Running totals along a distributed sort order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .scratch import materialize


def running_starts(df: DataFrame, order: list[str], size: str, carry: list[str]) -> tuple[DataFrame, np.ndarray]:
    """(``carry``, part, local: sum of ``size`` before in this part) in a global order, and the start of each part.

    Rows are range-partitioned by ``order``; the driver gets one total per partition. A row's start is
    ``starts[part] + local``. ``order`` should end with a column without ties, so that equal keys split.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index(size)).to_numpy().astype(np.int64)
            ends = total + np.cumsum(n)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n)], [*carry, "part", "local", "size"])
            total = int(ends[-1]) if len(n) else total

    ranged = df.select(*dict.fromkeys([*order, size, *carry])).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(ranged.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", part int, local long, size long"), "starts")
    totals = placed.groupBy("part").agg({"size": "sum"}).collect()
    sums = np.zeros(max([r["part"] for r in totals], default=-1) + 2, np.int64)
    for r in totals:
        sums[r["part"] + 1] = r["sum(size)"]
    return placed.drop("size"), np.cumsum(sums)
