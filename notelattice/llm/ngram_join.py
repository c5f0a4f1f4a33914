"""N-gram Jaccard join with signature trees.

``jaccard_classes`` finds the connected components of "Jaccard of the word-shingle sets >= threshold", exactly:

1. Documents with equal shingle sets collapse to the one with the smallest id (by a 128-bit set key).
2. Sets meet in buckets. From a threshold of PARTED percent on, the hashes are cut into two ranges more than the
   shingles that two similar sets can differ in: at least two ranges are equal in both, and a bucket is one range's whole
   content. So a passage that many documents share brings no two of them together. The number of ranges follows the size;
   sizes of similar sets lie in one or in neighbouring size classes, and each set is cut for both pairs of classes. A set
   in which two ranges are empty, and every set below PARTED, uses a prefix filter: shingles are put in one global order,
   shared ones last, and two similar sets share a shingle among the first ``n - ceil(t n) + 1``. Of buckets with the same
   members one is kept; they are told apart by 192 bits of hashes and the smallest id.
3. Every set is compared with the smallest id of each of its buckets, which connects groups of near copies with
   a linear number of comparisons.
4. Buckets that still hold two components get a signature tree: leaves hold sets ordered by size, inner nodes
   the OR of their bitmaps, their size range and the largest surplus of shingles over bits. A dual traversal
   drops node pairs whose largest possible overlap is below what their smallest sizes need. Sets of a bucket's largest
   component only meet the others; large buckets are cut into blocks, and pairs of blocks are traversed in
   different tasks.
5. Sets that keep a partner are traversed once more with their shingles at hand: leaf pairs are verified in the task,
   which returns a spanning forest of the links it finds. So a task's output is at most as large as its input, whatever
   the number of similar pairs. Components are then taken over all links.

Null ids: such rows keep null as id; their component is the smallest id of their class, null where there is none.
Null, empty and white texts have an empty set and link with nothing. Repeated rows share a component by their equal
sets; rows that share an id are one node, whatever their texts. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .scratch import discard, fresh, materialize
from .textcols import byte_slices, mix, row_slices, shingle_hashes, span_hashes, word_spans

#: A bitmap has the power of two of bits that is at least SPREAD times the set's size, within these bounds.
SPREAD, MIN_BITS, MAX_BITS = 1.25, 256, 8192
#: Most ids that a semi-join broadcasts; beyond it the texts are dealt by id.
BROADCAST = 1_000_000
FANOUT = 16
#: Percentage from which buckets are ranges of hashes; below it ranges would hold few shingles.
PARTED = 88
#: Rows and shingles of a block; larger buckets are cut into blocks of about this size.
BLOCK, BLOCK_SHINGLES = 4000, 1_000_000
#: Bytes of bitmaps or of shingles that one task holds, about, and leaf pairs that are verified at a time.
TASK_BYTES, LEAF_PAIRS = 16 << 20, 4096
#: A shingle is put last in the order if it makes up this share of all shingles, so there are at most 1 / share of them.
SHARED = 1e-6


def _doc_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row in batch, sorted distinct shingle hashes) for each row, empty sets included."""
    for i, j, data, offsets in byte_slices(batch):
        s, e, rows = word_spans(data, offsets)
        h, r = shingle_hashes(span_hashes(data, s, e, lower=True), rows, j - i, n)
        cut = np.searchsorted(r, np.arange(j - i + 1))
        for k in range(j - i):
            yield i + k, np.unique(h[cut[k] : cut[k + 1]])


def shared_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that make up SHARED of all, at most 1 / SHARED of them.

    Only the order of shingles depends on them, never which pairs are found.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            sets = [x for _, x in _doc_sets(batch, n)]
            if not sets:
                continue
            every = np.concatenate(sets)
            h, c = np.unique(every, return_counts=True)
            many = c >= max(3, SHARED * len(every))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h[many].view(np.int64), 0)), pa.array(np.append(c[many], len(every)).astype(np.int64)), pa.array([False] * int(many.sum()) + [True])], ["h", "c", "total"])

    found = materialize(docs.select("text").mapInArrow(count, "h long, c long, total boolean").groupBy("total", "h").agg(F.sum("c").alias("c")), "shared")
    total = found.where("total").agg(F.sum("c")).first()[0] or 0
    rows = found.where(~F.col("total") & (F.col("c") >= F.lit(max(8, SHARED * total)))).select("h", "c").toPandas()
    h, c = rows["h"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _width(size: int) -> int:
    """Bits of the bitmap of a set of ``size`` shingles."""
    return min(MAX_BITS, max(MIN_BITS, 1 << int(SPREAD * size).bit_length()))


def _class_edges(percent: int, largest: int) -> np.ndarray:
    """First sizes of the size classes: sets whose sizes differ by at most ``percent`` are at most one class apart."""
    edges = [1]
    while edges[-1] <= largest * 100 // percent + 1:
        edges.append(max(edges[-1] + 1, -(-100 * edges[-1] // percent)))
    return np.array(edges)


def bucket_keys(x: np.ndarray, prefix: np.ndarray, percent: int, edges: np.ndarray) -> np.ndarray:
    """Keys of the buckets of a set of sorted shingle hashes; two sets that reach ``percent`` have one in common."""
    if percent < PARTED:
        return prefix
    own = int(np.searchsorted(edges, len(x), "right")) - 1
    keys = []
    for c in (own, own + 1):  # classes c - 1 and c meet here; the smaller set is below edges[c]
        differ = int(edges[c] - 1) * (100 - percent) // percent
        if not differ:
            continue  # only equal sets are similar
        salt = np.uint64((c + 1) * 0x9E3779B97F4A7C15 % 2**64)
        ranges = differ + 2
        part = ((x >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        content = np.add.reduceat(mix(x ^ np.uint64(0xA24BAED4963EE407)), first)
        keys.append(mix(mix(content + part[first]) + salt))
        if len(first) < ranges - 1:  # a pair may agree in empty ranges only, and then both sets come here
            keys.append(mix(prefix + (salt ^ np.uint64(1))))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (set key), keys (of its buckets), bits (OR bitmap of the set)."""
    spark = docs.sparkSession
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    common = spark.sparkContext.broadcast(none if percent >= PARTED else shared_shingles(docs, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, counts = common.value
        edges = _class_edges(percent, 1 << 10)
        for batch in row_slices(batches):
            ids = batch.column(0)
            out: list[list] = [[], [], [], [], [], []]
            for row, x in _doc_sets(batch, n):
                size = len(x)
                if size * 100 // percent >= edges[-2]:
                    edges = _class_edges(percent, 2 * size)
                keep = size - -(-percent * size // 100) + 1 if size else 0
                if size and len(shared):
                    at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
                    rank = np.where(shared[at] == x, counts[at], 0)
                    first = x[np.argsort(rank, kind="stable")[:keep]]
                else:
                    first = x[:keep]
                width = _width(size)
                bits = np.zeros(width, np.uint8)
                bits[(x % np.uint64(width)).astype(np.int64)] = 1
                keys = bucket_keys(x, first, percent, edges) if size else first
                for c, v in zip(out, (ids[row].as_py(), size, int(x.sum().astype(np.uint64).view(np.int64)) if size else 0, int(mix(x ^ np.uint64(0x5BD1E995)).sum().view(np.int64)) if size else 0, keys.view(np.int64), np.packbits(bits, bitorder="little").tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], ["doc_id", "n_shingles", "k1", "k2", "keys", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>, bits binary")


class Tree:
    """Levels of nodes over sets ordered by size: OR bitmaps, size ranges and surplus of shingles over bits.

    ``rows`` names the sets, ``size`` and ``bits`` are theirs.
    """

    def __init__(self, rows: np.ndarray, size: np.ndarray, bits: np.ndarray):
        self.order = rows
        level = (bits, size, size, size - np.bitwise_count(bits).sum(1).astype(np.int64))
        self.levels = [level]
        while len(level[0]) > FANOUT:
            at = np.arange(0, len(level[0]), FANOUT)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)


def _may_overlap(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of node i of a and node j of b can overlap as much as their smallest sizes need."""
    most = np.minimum(a[2][i], b[2][j])
    ok = 100 * most >= percent * np.maximum(a[1][i], b[1][j])
    at = np.flatnonzero(ok)
    shared = np.bitwise_count(a[0][i[at]] & b[0][j[at]]).sum(1).astype(np.int64)
    most = np.minimum(most[at], shared + np.minimum(a[3][i[at]], b[3][j[at]]))
    ok[at] = (100 + percent) * most >= percent * (a[1][i[at]] + b[1][j[at]])
    return ok


def dual_traversal(a: Tree, b: Tree, same: bool, percent: int, apart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) that may be similar; ``apart(rows, rows)`` drops pairs already connected."""
    top = min(len(a.levels), len(b.levels)) - 1
    start = [(x.ravel(), y.ravel()) for x, y in [np.meshgrid(np.arange(len(a.levels[top][0])), np.arange(len(b.levels[top][0])), indexing="ij")]]
    stack = [(top, *start[0])]
    while stack:
        level, i, j = stack.pop()
        if len(i) > 1 << 16:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        if same:
            keep = i < j if level == 0 else i <= j
            i, j = i[keep], j[keep]
        if level == 0:
            keep = apart(a.order[i], b.order[j])
            i, j = i[keep], j[keep]
        ok = _may_overlap(a.levels[level], b.levels[level], i, j, percent) if len(i) else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            yield a.order[i], b.order[j]
            continue
        kid = np.arange(FANOUT)
        ii = (i[:, None, None] * FANOUT + kid[None, :, None] + np.zeros((1, 1, FANOUT), np.int64)).ravel()
        jj = (j[:, None, None] * FANOUT + kid[None, None, :] + np.zeros((1, FANOUT, 1), np.int64)).ravel()
        inside = (ii < len(a.levels[level - 1][0])) & (jj < len(b.levels[level - 1][0]))
        stack.append((level - 1, ii[inside], jj[inside]))


def _columns(t: pa.Table) -> tuple[dict[str, np.ndarray], list[bytes]]:
    return {c: t.column(c).to_numpy() for c in t.column_names if c != "bits"}, t.column("bits").to_pylist()


def _matrix(bits: list[bytes], rows: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of ``rows``, folded to ``width`` bytes: a bit stands for a shingle's hash modulo the number of bits."""
    out = np.zeros((len(rows), width), np.uint8)
    for k, r in enumerate(rows.tolist()):
        b = np.frombuffer(bits[r], np.uint8)
        out[k] = b if len(b) == width else np.bitwise_or.reduce(b.reshape(-1, width), 0)
    return out.view(np.uint64)


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, set: sorted shingle hashes) of the rows of ``docs`` whose ids ``wanted`` (doc_id, distinct) names."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for row, x in _doc_sets(batch, n):
                ids.append(batch.column(0)[row].as_py())
                sets.append(x.tobytes())
                size += len(sets[-1])
                if len(ids) == 2000 or size > TASK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "set"])
                    ids, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "set"])

    wanted = materialize(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted  # at most 8 MB of ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return materialize(texts.mapInArrow(shingles, "doc_id long, set binary"), "sets")


def verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets reach the threshold."""
    pairs = materialize(pairs.distinct(), "pairs")
    sets = shingle_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), n)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            t = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], ["a", "b"])

    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    links = materialize(two.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long").distinct(), "links")
    discard(pairs, sets)
    return links


def buckets(reps: DataFrame, percent: int) -> DataFrame:
    """(doc_id, size, key, total, pivot, near): the places of sets in buckets of at least two rows.

    ``total`` is the number of a bucket's shingles, ``pivot`` its smallest id, ``near`` whether the sizes of set and pivot
    allow a link. Of buckets with the same members, told by their number, smallest id, shingles and two independent 64-bit
    hashes of the ids (so two different buckets of two members are never taken for one), only the first is kept.
    """
    places = reps.select("doc_id", F.explode("keys").alias("key"))
    twice = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(fresh("key"))
    places = materialize(places.join(twice, "key", "left_semi").join(reps.select("doc_id", F.col("n_shingles").alias("size")), "doc_id"), "places")
    # the count is of rows, so one id alone may share a bucket with itself; such a bucket yields nothing
    one, two = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(1))
    half = (1 << 32) - 1
    held = places.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2"), F.sum(one.bitwiseAND(half)).alias("s1"), F.sum(two.bitwiseAND(half)).alias("s2"),
        F.sum("size").alias("total"), F.min(F.struct("doc_id", "size")).alias("p"),
    )
    held = held.groupBy("n", "x1", "x2", "s1", "s2", "total", "p").agg(F.min("key").alias("key")).select(fresh("key"), "total", F.col("p.doc_id").alias("pivot"), F.col("p.size").alias("pivot_size"))
    near = 100 * F.least("size", "pivot_size") >= percent * F.greatest("size", "pivot_size")
    out = materialize(places.join(held, "key").select("doc_id", "size", "key", "total", "pivot", near.alias("near")), "buckets")
    discard(places)
    return out


def likely_pairs(near: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a = pivot, b = doc_id) of ``near`` that the bitmaps of ``light`` don't rule out."""
    with_doc = near.join(light, "doc_id")
    with_both = with_doc.join(light.select(F.col("doc_id").alias("pivot"), F.col("size").alias("psize"), F.col("bits").alias("pbits")), "pivot")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            x, xb = _columns(t.select(["doc_id", "size", "bits"]))
            y, yb = _columns(t.select(["pivot", "psize", "pbits"]).rename_columns(["pivot", "size", "bits"]))
            width = np.minimum([len(b) for b in xb], [len(b) for b in yb])
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                a, b = (Tree(at, v["size"][at], _matrix(bits, at, int(w))).levels[0] for v, bits in ((x, xb), (y, yb)))
                each = np.arange(len(at))
                at = at[_may_overlap(a, b, each, each, percent)]
                yield from pa.table({"a": y["pivot"][at], "b": x["doc_id"][at]}).to_batches()

    return with_both.mapInArrow(likely, "a long, b long")


def open_cells(lab: DataFrame) -> DataFrame:
    """(doc_id, size, component, cell (key, own, i, j, h)) of sets in buckets that hold two components.

    A bucket's cells are pairs (i, j) of its blocks; ``own`` is the set's block and ``h`` names the cell's task. Pairs of
    blocks of the largest component are left out, so its sets travel once for each block of the others.
    """
    per = lab.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("size").alias("shingles"))
    per = per.groupBy("key").agg(F.max(F.struct("rows", "component", "shingles")).alias("main"), F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")).where("parts > 1")

    def blocks(rows, shingles):
        return F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")

    small = blocks(F.col("rows"), F.col("shingles")) == 1
    per = per.select(
        fresh("key"), F.col("main.component").alias("main"), small.alias("small"), blocks(F.col("main.rows"), F.col("main.shingles")).alias("mains"),
        blocks(F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles")).alias("others"),
    )
    rows = lab.join(per, "key")
    in_main = F.col("component") == F.col("main")
    spread = F.xxhash64("doc_id")
    own = F.when(F.col("small"), 0).when(in_main, F.pmod(spread, F.col("mains"))).otherwise(F.col("mains") + F.pmod(spread, F.col("others"))).cast("int")
    last = F.col("mains") + F.col("others") - 1
    meets = F.when(F.col("small"), F.array(F.lit(0))).when(in_main, F.sequence(F.col("mains"), last)).otherwise(F.sequence(F.lit(0), last))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(meets))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    # small buckets of one pivot meet in one task, where a set comes once for all of them
    h = F.xxhash64("pivot", "i", "j", F.when(F.col("total") * 8 > TASK_BYTES // 8, F.col("key")))
    return rows.select("doc_id", "size", "component", F.struct("key", "own", "i", "j", h.alias("h")).alias("cell"))


def dealt(rows: DataFrame, bytes_each, least: int) -> DataFrame:
    """``rows`` of (doc_id, size, component, cell) as one row (task, doc_id, component, cells) per task and set."""
    total = rows.agg(F.sum(bytes_each)).first()[0] or 0
    tasks = max(least, math.ceil(total / TASK_BYTES))
    return rows.groupBy(F.pmod("cell.h", F.lit(tasks)).alias("task"), "doc_id").agg(F.first("component").alias("component"), F.collect_list("cell").alias("cells"))


class Cells:
    """The cells of one task's sets; ``each`` is the row of the task's table that a place belongs to."""

    def __init__(self, t: pa.Table):
        lists = t.column("cells").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.each = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        self.flat = lists.flatten()
        self.key, self.own, self.i, self.j = (self.flat.field(k).to_numpy(zero_copy_only=False) for k in ("key", "own", "i", "j"))

    def traversals(self, size: np.ndarray, width: np.ndarray, label) -> Iterator[tuple[np.ndarray, np.ndarray, bool, int]]:
        """(places, places, whether both are the same, bytes of a bitmap) to traverse against each other.

        Of different widths, the narrower one serves both. ``label()`` gives the components of rows: cells of one
        component are passed over.
        """
        order = np.lexsort((self.each, size[self.each], self.j, self.i, self.key))
        keys = np.stack([self.key[order], self.i[order].astype(np.int64), self.j[order].astype(np.int64)])
        change = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0), True])
        for lo, hi in zip(change[:-1], change[1:]):
            at = order[lo:hi]
            of = label()[self.each[at]]
            if hi - lo < 2 or (of == of[0]).all():
                continue
            whole = bool(self.i[at[0]] == self.j[at[0]])
            left, right = (at, at) if whole else (at[self.own[at] == self.i[at]], at[self.own[at] == self.j[at]])
            wl, wr = width[self.each[left]], width[self.each[right]]
            for a in np.unique(wl).tolist():
                for b in np.unique(wr).tolist():
                    if not whole or a <= b:
                        yield left[wl == a], right[wr == b], whole and a == b, min(a, b)


_DEALT = "doc_id long, size long, component long, cell struct<key: long, own: int, i: int, j: int, h: long>"


def surviving_cells(dealt_rows: DataFrame, percent: int) -> DataFrame:
    """Those cells of ``dealt_rows`` (with size and bits) in which the bitmaps leave the set a partner of another component."""

    def trees(t: pa.Table) -> pa.Table:
        row, bits = _columns(t.select(["doc_id", "component", "size", "bits"]))
        cells = Cells(t)
        comp, kept = row["component"], np.zeros(len(cells.each), bool)
        for left, right, same, w in cells.traversals(row["size"], np.array([len(b) for b in bits]), lambda: comp):
            x = Tree(left, row["size"][cells.each[left]], _matrix(bits, cells.each[left], w))
            y = x if same else Tree(right, row["size"][cells.each[right]], _matrix(bits, cells.each[right], w))
            for p, q in dual_traversal(x, y, same, percent, lambda p, q: comp[cells.each[p]] != comp[cells.each[q]]):
                kept[p] = kept[q] = True
        at = np.flatnonzero(kept)
        each = cells.each[at]
        cell = cells.flat.take(pa.array(at))
        return pa.table({"doc_id": row["doc_id"][each], "size": row["size"][each], "component": comp[each], "cell": cell})

    return dealt_rows.groupBy("task").applyInArrow(trees, _DEALT)


def forest_links(dealt_rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within each task of ``dealt_rows`` (with set): a spanning forest of its links."""

    def trees(t: pa.Table) -> pa.Table:
        ids, comps = t.column("doc_id").to_numpy(), t.column("component").to_numpy()
        raw = t.column("set").to_pylist()
        size = np.array([len(x) // 8 for x in raw], np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        width = np.array([_width(k) // 8 for k in size.tolist()], np.int64)
        cells = Cells(t)
        comp = np.unique(comps, return_inverse=True)[1]
        a: list[int] = []
        b: list[int] = []

        def similar(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            """Whether rows p and q (sorted by p) reach the threshold on their full sets."""
            ok = np.zeros(len(p), bool)
            cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True]) if len(p) else np.zeros(0, np.int64)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                one, many = sets[p[lo]], [sets[k] for k in q[lo:hi].tolist()]
                flat = np.concatenate(many)
                hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
                both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum([len(m) for m in many])[:-1]]), dtype=np.int64)
                ok[lo:hi] = 100 * both >= percent * (len(one) + size[q[lo:hi]] - both)
            return ok

        def join(p: np.ndarray, q: np.ndarray) -> None:
            nonlocal comp
            for lo in range(0, len(p), LEAF_PAIRS):
                x, y = p[lo : lo + LEAF_PAIRS], q[lo : lo + LEAF_PAIRS]
                apart = comp[x] != comp[y]
                x, y = x[apart], y[apart]
                by = np.argsort(x, kind="stable")
                x, y = x[by], y[by]
                ok = similar(x, y)
                up: dict[int, int] = {}

                def find(c: int) -> int:
                    while c in up:
                        c = up[c]
                    return c

                for r, s in zip(x[ok].tolist(), y[ok].tolist()):
                    c, d = find(int(comp[r])), find(int(comp[s]))
                    if c != d:
                        up[max(c, d)] = min(c, d)
                        a.append(int(ids[r]))
                        b.append(int(ids[s]))
                if up:
                    names = np.arange(int(comp.max()) + 1)
                    for c in up:
                        names[c] = find(c)
                    comp = names[comp]

        def bitmaps(rows: np.ndarray, w: int) -> np.ndarray:
            bits = np.zeros((len(rows), w * 8), np.uint8)
            for k, r in enumerate(rows.tolist()):
                bits[k, (sets[r] % np.uint64(w * 8)).astype(np.int64)] = 1
            return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

        for left, right, same, w in cells.traversals(size, width, lambda: comp):
            x = Tree(left, size[cells.each[left]], bitmaps(cells.each[left], w))
            y = x if same else Tree(right, size[cells.each[right]], bitmaps(cells.each[right], w))
            for p, q in dual_traversal(x, y, same, percent, lambda p, q: comp[cells.each[p]] != comp[cells.each[q]]):
                join(cells.each[p], cells.each[q])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt_rows.groupBy("task").applyInArrow(trees, "a long, b long")


def jaccard_classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text); see the module's text."""
    spark = docs.sparkSession
    sigs = materialize(signatures(docs, n, percent), "sigs")
    full = sigs.where("n_shingles > 0")
    classes = materialize(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    named_docs = docs.where(F.col("doc_id").isNotNull())
    light = reps.select("doc_id", F.col("n_shingles").alias("size"), "bits")
    posts = buckets(reps, percent)

    # near copies: every set against the pivot of each of its buckets
    near = posts.where("near AND doc_id <> pivot").select("doc_id", "pivot").distinct()
    first = verify(named_docs, likely_pairs(near, light, percent), n, percent)
    joined = connected_components(first)

    # buckets that still hold two components: signature trees
    lab = posts.join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    lab = materialize(lab, "labelled")
    cells = materialize(open_cells(lab), "cells")
    discard(posts, lab)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = materialize(surviving_cells(dealt(cells, F.col("size") / 4 + 300, least).join(light, "doc_id"), percent), "kept-cells")
    sets = shingle_sets(named_docs, kept.select("doc_id").distinct(), n)
    second = materialize(forest_links(dealt(kept, F.col("size") * 8 + 300, least).join(sets, "doc_id"), percent), "forest")
    discard(cells, kept, sets)

    comps = connected_components(first.union(second))
    named = classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "k1", "k2").join(named.withColumn("k1", fresh("k1")), ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
