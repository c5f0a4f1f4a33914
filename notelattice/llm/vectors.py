"""Near-duplicate vectors by collision counting over one-dimensional projections.

1. Vectors with equal components collapse to the smallest id, with their number as weight.
2. ``tables`` cells per class: in each table the signs of ``bits`` random projections name a cell. Inside a cell,
   rows are sorted along one more projection and only rows inside a query-centred window are looked at.
3. For the pairs in a window, the projections on which both values lie within ``WIDTH`` of each other are
   counted; pairs that reach the calibrated count are verified by cosine in double precision.
4. A pair counts in the first table in which it shares a cell, so link counts add up without listing pairs; only
   a spanning forest of each cell's links is emitted, and components are taken over those.

``bits`` follows the number of classes and ``tables`` is set so that a pair at exactly the threshold is found
with probability RECALL; closer pairs are found more often. A cell of more than BLOCK rows is cut into blocks
whose pairs are separate groups, so a hot cell spreads over tasks and no row is dropped.

Null vectors, zero vectors and vectors with null or non-finite components have 0 links and are their own
component. Vectors of different length are never linked. Repeated ids count as separate vectors of one class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .scratch import fresh, materialize

RECALL = 0.985
WIDTH = 0.47
COUNTED = 64
BLOCK = 2048
SEED = 20240229


def plan(classes: int, threshold: float) -> tuple[int, int, int, float]:
    """(bits, tables, count, window) for ``classes`` vectors: all from the number of classes and the threshold."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(4, min(24, round(math.log2(max(classes, 2) / 32))))
    tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits * 0.999)))
    apart = math.sqrt(2 - 2 * threshold)
    p = math.erf(WIDTH / apart / math.sqrt(2))
    # the count that a pair at the threshold reaches with 0.999
    at, tail = 0, (1 - p) ** COUNTED
    while tail < 0.001 and at < COUNTED:
        at += 1
        tail += math.comb(COUNTED, at) * p**at * (1 - p) ** (COUNTED - at)
    return bits, tables, at, 3.5 * apart


def _directions(dim: int, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, COUNTED)), rng.standard_normal((dim, tables)), rng.standard_normal((dim, tables * bits))


def _codes(unit: np.ndarray, signs: np.ndarray, bits: int) -> np.ndarray:
    on = (unit @ signs > 0).reshape(len(unit), -1, bits)
    return (on * (1 << np.arange(bits))).sum(2)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, vec (components as doubles, little-endian; null where the vector can't link), k1, k2 (its key)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, k1, k2 = [], [], []
            for v in batch.column(1).to_pylist():
                ok = bool(v) and None not in v
                x = np.array(v, "<f8") if ok else np.zeros(0)
                top = float(np.abs(x).max()) if len(x) else 0.0
                if not math.isfinite(top) or top == 0.0:  # NaN is not finite
                    vecs.append(None)
                    k1.append(None)
                    k2.append(None)
                    continue
                key = hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()
                vecs.append(x.tobytes())
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["vec_id", "vec", "k1", "k2"])

    return rows.mapInArrow(read, "vec_id long, vec binary, k1 long, k2 long")


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (row, root), of links i-j among n rows."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.9, tune: tuple[int, int] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows`` (vec_id, embedding); see the module's text.

    ``tune`` overrides (bits, tables).
    """
    spark = rows.sparkSession
    vecs = materialize(unit_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")), "vectors")
    good = vecs.where("vec IS NOT NULL")
    classes = materialize(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")), "vector-classes")
    n = classes.count()
    bits, tables, least, window = plan(n, threshold)
    if tune:
        bits, tables = tune
    reps = good.join(classes.select(F.col("rep").alias("vec_id"), "k1", "k2", "w"), ["vec_id", "k1", "k2"]).dropDuplicates(["vec_id", "k1", "k2"]).select("vec_id", "w", "vec")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            dims = np.array([len(v) // 8 for v in raw], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                codes = _codes(_unit([raw[k] for k in at], int(dim)), _directions(int(dim), bits, tables)[2], bits)
                some = batch.take(pa.array(at))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array((codes[:, t] + (t << bits)) * 65536 + min(int(dim), 65535)), *some.columns], ["cell", "vec_id", "w", "vec"])

    placed = reps.mapInArrow(cells, "cell long, vec_id long, w long, vec binary")
    sizes = reps.select("vec_id", "w", "vec").mapInArrow(cells, "cell long, vec_id long, w long, vec binary").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    big = materialize(sizes, "big-cells")  # at most n * tables / BLOCK rows
    if big.isEmpty():
        placed = placed.withColumn("own", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        placed = placed.join(big.withColumn("cell", fresh("cell")), "cell", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
        placed = placed.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * tables / 50_000))
    placed = placed.select("cell", "own", "i", "j", "vec_id", "w", "vec", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(parts)).cast("int").alias("task"))

    def count(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("cell", "own", "i", "j", "vec_id", "w")}
        raw = table.column("vec")
        order = np.lexsort((col["vec_id"], col["j"], col["i"], col["cell"]))
        key = np.stack([col[c][order] for c in ("cell", "i", "j")])
        change = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True])
        node: list[np.ndarray] = []
        links: list[np.ndarray] = []
        root: list[np.ndarray] = []
        for lo, hi in zip(change[:-1], change[1:]):
            if hi - lo < 2:
                continue
            at = order[lo:hi]
            dim = len(raw[int(at[0])].as_buffer()) // 8
            unit = _unit([raw[int(k)].as_py() for k in at], dim)
            counted, along, signs = _directions(dim, bits, tables)
            t = int(col["cell"][at[0]] // 65536 >> bits)
            line = unit @ along[:, t]
            rank = np.argsort(line, kind="stable")
            at, unit, line = at[rank], unit[rank], line[rank]
            proj = (unit @ counted).astype(np.float32)
            own, same = col["own"][at], col["i"][at[0]] == col["j"][at[0]]
            ids, w = col["vec_id"][at], col["w"][at]
            m = len(at)
            found_i: list[np.ndarray] = []
            found_j: list[np.ndarray] = []
            for b in range(0, m, 128):
                e = min(m, b + 128)
                stop = int(np.searchsorted(line, line[e - 1] + window, "right"))
                for c in range(b, stop, 512):
                    d = min(stop, c + 512)
                    hits = np.zeros((e - b, d - c), np.uint8)
                    for q in range(COUNTED):
                        hits += np.abs(proj[b:e, q, None] - proj[None, c:d, q]) <= WIDTH
                    x, y = np.nonzero(hits >= least)
                    x, y = x + b, y + c
                    keep = (x < y) & (line[y] - line[x] <= window)
                    if not same:
                        keep &= own[x] != own[y]
                    x, y = x[keep], y[keep]
                    if len(x):
                        cos = np.einsum("ij,ij->i", unit[x], unit[y])
                        x, y = x[cos >= threshold], y[cos >= threshold]
                    if len(x) and t:
                        used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                        codes = _codes(unit[used], signs[:, : t * bits], bits)
                        first = ~(codes[back[: len(x)]] == codes[back[len(x) :]]).any(1)
                        x, y = x[first], y[first]
                    found_i.append(x)
                    found_j.append(y)
            x, y = np.concatenate(found_i), np.concatenate(found_j)
            if not len(x):
                continue
            total = np.bincount(x, w[y], m) + np.bincount(y, w[x], m)
            up = np.full(m, -1, np.int64)
            rows_, roots = _forest(m, x, y)
            up[rows_] = ids[roots]
            some = total > 0
            node.append(ids[some])
            links.append(total[some].astype(np.int64))
            root.append(np.where(up[some] == -1, ids[some], up[some]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"node": np.concatenate(node or none), "links": np.concatenate(links or none), "root": np.concatenate(root or none)})

    found = materialize(placed.groupBy("task").applyInArrow(count, "node long, links long, root long"), "collisions")
    comps = connected_components(found.where("node <> root"), "node", "root")
    per = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(per.withColumnRenamed("node", "rep"), "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(fresh("k1"), "k2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = vecs.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
