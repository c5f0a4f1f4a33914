"""Spelling variant grouping by dense prefix-suffix tiling.

1. Words of every text are counted in Spark; words of at least ``min_length`` code points and ``min_count`` occurrences stay.
2. Two words differ by one inserted, deleted or replaced code point exactly if common prefix plus common suffix reach the
   longer length minus one. For each length of the longer word its places are cut into PIECES pieces, the edit lies in one of
   them, and all before and all behind it is equal: words meet in buckets of (length, piece, what is before, what is behind),
   told by a 64-bit hash.
3. Within a task words lie ordered by length and bucket, in blocks of rows. Padded code-point matrices, aligned left and
   right, compare every block with itself and with the blocks that its last bucket reaches: common prefixes and suffixes of
   all pairs of two blocks at once. A pair counts in the first piece that its prefix and suffix leave open, so in one bucket.
   Buckets of more than BUCKET words are cut into blocks whose pairs go to different tasks.
4. A task returns, for each word, how many near words it met and the most frequent of them; both add up over tasks, so near
   pairs are never listed. ``form`` of a word leads to a word of at least ``ratio`` times its occurrences, so chains are short;
   the last word of a chain is found by doubling.

Null texts have no words. Rows without an id count, and lose no code point. Repeated rows count twice. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import discard, fresh, materialize
from .textcols import LOWER, byte_slices, mix, row_slices

PIECES = 4
#: Most words of a bucket that one task compares; larger ones are cut into blocks of this size.
BUCKET = 4096
#: Rows of a tile's side, and bytes of code points that tiles compare at a time.
TILE, TILE_BYTES = 64, 4 << 20
#: Keyed words that a task gets, about.
TASK_ROWS = 200_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SHORT = 64
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row and code points of each maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` in UTF-8; runs never cross rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 4
    lead = data == 0xC3  # leads U+00C0 to U+00FF and nothing else
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, ends - starts - (leads[ends] - leads[starts])


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the bytes of each span, continued from the crc32 in ``seeds``: byte by byte over all spans at once."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], starts[order]
    crc = ~seeds[order].astype(np.uint32)
    for k in range(min(_SHORT, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -k, "left"))  # spans longer than k
        crc[:n] = _CRC[(crc[:n] ^ data[begin[:n] + k]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    crc = ~crc
    for k in range(int(np.searchsorted(-size, -_SHORT, "left"))):  # long spans go on one by one
        crc[k] = zlib.crc32(data[begin[k] + _SHORT : begin[k] + size[k]].tobytes(), int(crc[k]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of all spans as one Arrow array of strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - offsets[:-1], size) + np.arange(int(offsets[-1]))
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at]))


def typed_words(docs: DataFrame, min_length: int, typo: int = 31) -> DataFrame:
    """(word, n): words of ``docs`` (doc_id, text), lower-cased, with a code point left out where ``typo`` divides a run's crc32.

    The crc32 is that of "<doc_id>:<run>", the place left out is the crc32 modulo the run's length; ``typo`` 0 leaves none out,
    nor does a row without an id lose any.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            ids = batch.column(0).to_pylist()
            seed = np.array([zlib.crc32(f"{i}:".encode()) if i is not None else 0 for i in ids], np.uint32)
            named = np.array([i is not None for i in ids], bool)
            found: list[pa.Array] = []
            for i, _, data, offsets in byte_slices(batch):
                starts, ends, rows, length = letter_runs(data, offsets)
                keep = length >= min_length
                starts, ends, rows, length = starts[keep], ends[keep], rows[keep] + i, length[keep]
                data = LOWER[data]
                typos = np.zeros(len(starts), bool)
                if typo and len(starts):
                    crc = crc32_spans(data, starts, ends, seed[rows])
                    typos = (crc % np.uint32(typo) == 0) & named[rows]
                found.append(_spans(data, starts[~typos], ends[~typos]))
                cut = []
                for k in np.flatnonzero(typos & (length > min_length)).tolist():
                    run, at = data[starts[k] : ends[k]].tobytes().decode(), int(crc[k]) % int(length[k])
                    cut.append(run[:at] + run[at + 1 :])
                found.append(pa.array(cut, pa.large_string()))
            if found:
                counts = pa.concat_arrays(found).value_counts()
                yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], ["word", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keyed(words: DataFrame) -> DataFrame:
    """(slot, key, word, n): the buckets of each word, as the longer or equal word and as the shorter one.

    ``slot`` is the longer word's length times PIECES plus the piece.
    """

    def hashes(points: np.ndarray, wanted: set[int]) -> dict[int, np.ndarray]:
        """Hashes of the first k columns, for each k of ``wanted``."""
        h, out = np.zeros(len(points), np.uint64), {}
        for k in range(max(wanted) + 1):
            if k in wanted:
                out[k] = h
            if k < points.shape[1]:
                h = mix(h * _MULT + points[:, k] + np.uint64(1))
        return out

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 20_000):
            text = batch.column(0).to_pylist()
            size = np.array([len(w) for w in text], np.int64)
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                points = np.frombuffer("".join(text[k] for k in at.tolist()).encode("utf-32-le"), "<u4").reshape(len(at), length).astype(np.uint64)
                spans = [(longer, piece, lo, longer - hi) for longer in (length, length + 1) for piece, (lo, hi) in enumerate(pieces(longer)) if hi > lo]
                before, behind = hashes(points, {x[2] for x in spans}), hashes(points[:, ::-1], {x[3] for x in spans})
                rows = batch.take(pa.array(at))
                for longer, piece, lo, rest in spans:
                    key = mix(mix(before[lo] + np.uint64(longer * PIECES + piece)) * _MULT + behind[rest]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), longer * PIECES + piece, np.int64)), pa.array(key), *rows.columns], ["slot", "key", "word", "n"])

    return words.select("word", "n").mapInArrow(keys, "slot long, key long, word string, n long")


def pieces(length: int) -> list[tuple[int, int]]:
    """Begin and end of the pieces of a word of ``length`` code points."""
    return [(k * length // PIECES, (k + 1) * length // PIECES) for k in range(PIECES)]


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of all pairs of rows of a[t] and b[t], for padded matrices a, b of tiles t."""
    run = np.ones((len(a), a.shape[1], b.shape[1]), bool)
    out = np.zeros(run.shape, np.int32)
    for k in range(a.shape[2]):
        run &= a[:, :, None, k] == b[:, None, :, k]
        if not run.any():
            break
        out += run
    return out


def near_in_tiles(words: list[str], slot: np.ndarray, bucket: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket that are one edit apart; rows are ordered by slot and bucket.

    With ``side``, rows of a bucket that has two sides meet only across them.
    """
    for length in np.unique(slot // PIECES).tolist():
        mine = np.flatnonzero(slot // PIECES == length)
        tile = max(1, min(TILE, math.isqrt(TILE_BYTES // (4 * length))))
        blocks = -(-len(mine) // tile)
        at = np.full(blocks * tile, -1)  # the last block is filled up
        at[: len(mine)] = mine
        left, right, size = np.zeros((len(at), length), np.uint32), np.zeros((len(at), length), np.uint32), np.zeros(len(at), np.int32)
        size[: len(mine)] = [len(words[k]) for k in mine.tolist()]
        for n in np.unique(size[: len(mine)]).tolist():
            rows = np.flatnonzero(size == n)
            points = np.frombuffer("".join(words[k] for k in at[rows].tolist()).encode("utf-32-le"), "<u4").reshape(len(rows), n)
            left[rows, :n], right[rows, :n] = points, points[:, ::-1]
        own = np.where(at >= 0, bucket[at], -1 - np.arange(len(at)))
        begins, ends = own[::tile], np.append(own[tile - 1 : -1 : tile], own[len(mine) - 1])
        one, two, step = [np.arange(blocks)], [np.arange(blocks)], 1  # a block with itself, and with those that its last bucket reaches
        while step < blocks and len(reach := np.flatnonzero(ends[:-step] == begins[step:])):
            one.append(reach)
            two.append(reach + step)
            step += 1
        x, y = np.concatenate(one), np.concatenate(two)
        shape, many = (blocks, tile, length), max(1, TILE_BYTES // (4 * tile * tile))
        starts, stops = np.array(pieces(length)).T
        for lo in range(0, len(x), many):
            p, q = x[lo : lo + many], y[lo : lo + many]
            a, b = p[:, None] * tile + np.arange(tile), q[:, None] * tile + np.arange(tile)
            may = (own[a][:, :, None] == own[b][:, None, :]) & (a[:, :, None] < b[:, None, :])
            if side is not None:
                two_sided = side[at[a]] >= 0
                may &= ~two_sided[:, :, None] | (side[at[a]][:, :, None] != side[at[b]][:, None, :])
            some = may.any((1, 2))
            if not some.any():
                continue
            p, q, a, b, may = p[some], q[some], a[some], b[some], may[some]
            least, most = np.minimum(size[a][:, :, None], size[b][:, None, :]), np.maximum(size[a][:, :, None], size[b][:, None, :])
            head = np.minimum(_prefix(left.reshape(shape)[p], left.reshape(shape)[q]), least)
            tail = np.minimum(_prefix(right.reshape(shape)[p], right.reshape(shape)[q]), least)
            t, i, j = np.nonzero(may & (most == length) & (head + tail >= length - 1))
            h, s = head[t, i, j], tail[t, i, j]
            i, j = a[t, i], b[t, j]
            # prefix and suffix leave one or more pieces open; the pair counts in the first one
            first = ((starts <= h[:, None]) & (length - stops <= s[:, None]) & (stops > starts)).argmax(1)
            counts = first == slot[at[i]] % PIECES
            yield at[i[counts]], at[j[counts]]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best (less: -n, word)) for words of ``words`` (word, n; distinct) that have near ones: their number, the most frequent one."""
    spark = words.sparkSession
    rows = keyed(words)
    large = materialize(rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > BUCKET), "large-buckets")
    cut = not large.isEmpty()
    if cut:
        blocks = F.coalesce(F.ceil(F.col("rows") / BUCKET), F.lit(1)).cast("int")
        rows = rows.join(large.withColumn("key", fresh("key")), "key", "left").withColumn("own", F.pmod(F.xxhash64("word"), blocks).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        rows = rows.withColumn("side", F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("own")))
    at = ["i", "j"] if cut else []
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(words.count() * 2 * PIECES / TASK_ROWS))
    rows = rows.select("slot", "key", "word", "n", *at, *(["side"] if cut else []), F.pmod(F.xxhash64("key", *at), F.lit(tasks)).cast("int").alias("task"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("slot", "key", *at)])
        named = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("slot", "key", *at)])
        bucket = np.cumsum(np.concatenate([[0], (named[:, 1:] != named[:, :-1]).any(0)]))
        order = pc.sort_indices(t, sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()  # of UTF-8, which is that of code points
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        met, best = np.zeros(len(order), np.int64), np.full(len(order), len(order))
        for a, b in near_in_tiles(t.column("word").to_pylist(), named[0], bucket, t.column("side").to_numpy() if cut else None):
            for x, y in ((a, b), (b, a)):
                np.add.at(met, x, 1)
                np.minimum.at(best, x, rank[y])
        found = np.flatnonzero(met)
        other = t.take(pa.array(order[best[found]]))
        return pa.table({"word": t.column("word").take(pa.array(found)), "n_near": met[found], "best_n": other.column("n"), "best": other.column("word")})

    met = rows.groupBy("task").applyInArrow(compare, "word string, n_near long, best_n long, best string")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form), both not null: the last word of each chain, found by doubling."""
    step = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = step.select(F.col("word").alias("root"), F.col("root").alias("far"))
        nxt = materialize(step.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        discard(step)
        if nxt.where("moved").isEmpty():
            return nxt.select("word", "root")
        step = nxt.select("word", "root")
        step._scratch_path = nxt._scratch_path


def spelling_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words`` (word, n; distinct, not null): see the module's text."""
    near = materialize(near_words(words), "near")
    good: Column = -F.col("best.less") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")
    )
    joined = materialize(joined, "forms")
    ends = roots(joined.where("form IS NOT NULL").select("word", "form"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """``spelling_groups`` of the words of ``docs`` (doc_id, text) as ``typed_words`` reads them."""
    words = materialize(typed_words(docs, min_length).where(F.col("n") >= min_count), "words")
    return spelling_groups(words, ratio)
