"""Objects of JSON bundles, read in splits: a bundle is one document, {"objects": [{...}, ...]}, which may have many gigabytes.

Files are read as text whose lines end at closing braces, so Spark cuts them where it likes. Whether a cut lies in a text, and
how deep, follows from what is before it: a first pass counts marks and braces of each split, for both cases of its beginning,
and running sums over the splits of a file tell which case holds. A second pass then takes the objects out of all splits side
by side; what a cut parts is put together by file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Depth of an object: in the document's braces, in the list's brackets, in its own braces.
DEPTH = 3

STEP = np.zeros(256, np.int64)
STEP[[ord("{"), ord("[")]], STEP[[ord("}"), ord("]")]] = 1, -1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Text of each run of lines of one split, with the braces that ended its lines."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        new = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            yield (path[i], int(block[i])), b"".join(x + b"}" for x in batch.column(2).slice(i, j - i).cast(pa.binary()).to_pylist())


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``data`` without its escapes, and the number of quotation marks up to each."""
    # an escape never ends in a brace, so none is parted by the end of a line
    plain = np.frombuffer(data.replace(b"\\\\", b"__").replace(b'\\"', b"__"), np.uint8)
    return plain, np.cumsum(plain == ord('"'))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split its marks, and its change of depth if it begins outside and inside of a text."""

    def row(key, marks, steps) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [key[0]], "block": [key[1]], "marks": [marks], "outside": [steps[0]], "inside": [steps[1]]})

    held, marks, steps = None, 0, [0, 0]
    for key, data in _runs(batches):
        if key != held:
            if held is not None:
                yield row(held, marks, steps)
            held, marks, steps = key, 0, [0, 0]
        plain, quotes = _marks(data)
        step = STEP[plain]
        for begin in (0, 1):
            steps[begin] += int(step[(quotes + marks + begin) % 2 == 0].sum())
        marks += int(quotes[-1])
    if held is not None:
        yield row(held, marks, steps)


def _begins(lines: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(in a text, depth) where each split but the first of its file begins: an entry per ``maxPartitionBytes`` of the large files."""
    counts = lines.where("length < size").select("path", "block", "value").mapInArrow(_count, "path string, block long, marks long, outside long, inside long")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = counts.withColumn("text", F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2)
    told = told.withColumn("depth", F.coalesce(F.sum(F.when(F.col("text") == 1, F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    return {(r["path"], r["block"]): (r["text"], r["depth"]) for r in told.where("block > 0").select("path", "block", "text", "depth").collect()}


WHOLE, END, BEGINNING = 0, 1, 2


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the bundle files below ``path``, one row of ``schema`` each.

    An object is a document in a list at a bundle's top, and bundles have one such list. Objects without a ``type`` and what
    isn't JSON are left out; of a bundle that is cut off, the objects before the cut count. A file of one split is parsed in
    one pass; compressed files are one split.
    """
    rows = spark.read.option("lineSep", "}").text(path)
    meta = lambda name: F.col(f"_metadata.{name}")
    lines = rows.select(meta("file_path").alias("path"), meta("file_block_start").alias("block"), "value", meta("file_block_length").alias("length"), meta("file_size").alias("size"))
    begins = spark.sparkContext.broadcast(_begins(lines))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, kinds: list[int], texts: list[bytes]) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())], ["path", "block", "kind", "object"])

        held, text, depth, part, first = None, 0, 0, [], False
        for key, data in _runs(batches):
            if key != held:
                if part:
                    yield out(held, [END if first else BEGINNING], [b"".join(part)])
                held, part = key, []
                text, depth = begins.value.get(key, (0, 0))
                first = depth >= DEPTH  # begins in an object of the split before
            plain, quotes = _marks(data)
            step = np.where((quotes + text) % 2 == 0, STEP[plain], 0)
            level = depth + np.cumsum(step)
            opens = np.flatnonzero((level == DEPTH) & (step == 1) & (plain == ord("{")))
            ends = np.flatnonzero((level == DEPTH - 1) & (step == -1) & (plain == ord("}"))) + 1
            kinds, texts = [], []
            if part or first:
                end = int(ends[0]) if len(ends) else len(data)
                part.append(data[:end])
                if len(ends):
                    kinds.append(END if first else WHOLE)
                    texts.append(b"".join(part))
                    part, first, ends = [], False, ends[1:]
            for i, j in zip(opens.tolist(), ends.tolist()):
                kinds.append(WHOLE)
                texts.append(data[i:j])
            if len(opens) > len(ends):
                part = [data[int(opens[-1]) :]]
            if texts:
                yield out(key, kinds, texts)
            text, depth = int(quotes[-1] + text) % 2, int(level[-1])
        if part:
            yield out(held, [END if first else BEGINNING], [b"".join(part)])

    found = lines.select("path", "block", "value").mapInArrow(take, "path string, block long, kind int, object string")
    if not begins.value:
        whole = found.where(F.col("kind") == WHOLE).select("object")
    else:
        parts = found.where(F.col("kind") != WHOLE)
        order = Window.partitionBy("path").orderBy("block", "kind")
        chain = parts.withColumn("chain", F.last(F.when(F.col("kind") == BEGINNING, F.col("block")), True).over(order))
        joined = chain.groupBy("path", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "object"))).alias("parts"))
        whole = found.where(F.col("kind") == WHOLE).select("object").union(joined.select(F.array_join(F.transform("parts", lambda p: p["object"]), "").alias("object")))
    return whole.select(F.from_json("object", schema).alias("o")).select("o.*").where("type IS NOT NULL")
