"""Substring de-duplication: Rabin-Karp hashes of every window of ``window`` words, counted in Spark.

1. Texts are written once as blocks: rows of about BLOCK_BYTES of texts, compressed, with their ids. A block is named by the
   partition and place it was written in, and all later steps read these files.
2. Each block hashes all its windows, keeps the earliest place of each distinct one, and sends the hashes to groups by hash,
   packed: one row per block and group, 8 bytes a window, with the ids of the rows they are from. The group follows from a hash
   of its own, so of n windows about n^2 / (groups * 2^65) pairs of different ones are taken for equal.
3. A group finds the hashes that came from an earlier row of another block as well and answers each block with a bit per
   window, if any is set. A window that a third of all documents hold comes once from each block.
4. A block hashes its windows again, marks what its own earlier windows or the answers name, and merges marked windows into
   maximal intervals of words to remove.

Windows are judged on the input, not on what is left. Earlier means: in a row of a smaller id, or in the same row and of a
smaller start. A null id counts as the largest. Rows that share an id, or have none, don't hold anything against each other,
so repeated rows keep the same words. Null, empty and white texts have no words. Texts of fewer words than
``window`` keep all. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import materialize
from .textcols import mix, span_hashes, word_spans
from .tokens import small_slices

#: Bytes and rows of a block's texts, about; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 4000
#: Bytes of packed hashes that a group gets, about.
GROUP_BYTES = 24 << 20
#: Bytes of packed hashes for each byte of text, about: eight for a word and the blank after it, of six bytes.
PACKED = 1.5
#: A row without an id comes where this id would.
NO_ID = (1 << 63) - 1
_BASE, _OTHER_BASE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_BLOCKS = "block long, ids array<long>, sizes array<int>, texts binary"


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, sizes: bytes of each text, -1 for null, texts: all of them, compressed), written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(3)
        for batch in batches:
            for part in small_slices(batch, 1, BLOCK_ROWS, BLOCK_BYTES):
                raws = [x.as_buffer().to_pybytes() if x.is_valid else None for x in part.column(1)]
                sizes = [-1 if r is None else len(r) for r in raws]
                texts = press.compress(b"".join(r for r in raws if r))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([texts], pa.binary())], ["block", "ids", "sizes", "texts"])
                number += 1

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, _BLOCKS), "blocks")


class Block:
    """The texts of one row of ``text_blocks`` and their windows.

    ``lead`` names, for each window, the window of the block that stands for all equal ones; ``ship`` has those by group, those
    of group g at ``cut[g] : cut[g + 1]``, in the order of their rows. ``repeated`` marks windows that an earlier one of the
    block equals.
    """

    def __init__(self, ids: list[int | None], sizes: list[int], texts: bytes, window: int, groups: int):
        data = zstandard.ZstdDecompressor().decompress(texts) if texts else b""
        offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int64)
        self.raws = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        starts, ends, rows = word_spans(flat, offsets)
        self.words = np.bincount(rows, minlength=len(ids))
        words = span_hashes(flat, starts, ends, lower=False)
        self.window, self.at = window, np.flatnonzero(_whole(rows, window))  # the first word of each window, block-wide
        self.row, self.hashes = rows[self.at], _rolled(words, self.at, window, _BASE)
        group = ((_rolled(words, self.at, window, _OTHER_BASE) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.uint16 if groups < 1 << 16 else np.int64)
        self.ids = ids
        self.keys = np.array([NO_ID if i is None else i for i in ids], np.int64)

        n = len(self.at)
        by_key = np.argsort(self.keys, kind="stable")  # rows in order
        per_row = np.bincount(self.row, minlength=len(ids))
        begin = np.empty(len(ids), np.int64)  # where a row's windows begin in that order
        begin[by_key] = np.cumsum(per_row[by_key]) - per_row[by_key]
        place = np.arange(n) + (begin - (np.cumsum(per_row) - per_row))[self.row]
        at_place = np.empty(n, np.int64)
        at_place[place] = np.arange(n)
        order = np.argsort(self.hashes)
        h, g = self.hashes[order], group[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if n else order
        leads = at_place[np.minimum.reduceat(place[order], new)] if n else order
        self.lead = np.empty(n, np.int64)
        self.lead[order] = np.repeat(leads, np.diff(np.append(new, n)))
        self.repeated = self.lead != np.arange(n)
        shared = np.flatnonzero(self.repeated & (self.keys[self.row] == self.keys[self.row[self.lead]]) & (self.row != self.row[self.lead]))
        if len(shared):  # rows that share an id: the first one in each row stays
            shared = shared[np.lexsort((shared, self.row[shared], self.lead[shared]))]
            first = np.concatenate([[True], (self.row[shared[1:]] != self.row[shared[:-1]]) | (self.lead[shared[1:]] != self.lead[shared[:-1]])])
            self.repeated[shared[first]] = False
        ship = np.sort(leads)
        self.ship = ship[np.argsort(group[ship], kind="stable")]
        self.cut = np.searchsorted(group[self.ship], np.arange(groups + 1))

    def mark(self, replies: dict[int, bytes]) -> None:
        """Mark windows of classes that the groups' answers name."""
        hit = np.zeros(len(self.hashes), bool)
        for group, bits in replies.items():
            at = self.ship[self.cut[group] : self.cut[group + 1]]
            hit[at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at), bitorder="little").astype(bool)
        self.repeated |= hit[self.lead]

    def removed(self) -> np.ndarray:
        """Whether each word of the block is covered by a marked window."""
        n = int(self.words.sum())
        edge = np.zeros(n + 1, np.int64)
        at = self.at[self.repeated]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        return np.cumsum(edge[:n]) > 0


def _whole(rows: np.ndarray, window: int) -> np.ndarray:
    """Whether a window that lies in one row begins at each word."""
    out = np.zeros(len(rows), bool)
    if len(rows) >= window:
        out[: len(rows) - window + 1] = rows[: len(rows) - window + 1] == rows[window - 1 :]
    return out


def _rolled(words: np.ndarray, at: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of the windows that begin at ``at``: sums of word hashes times powers of a base."""
    if not len(at):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, len(words)), out=sums[1:])
    return mix((sums[at + window] - sums[at]) * _powers(pow(base, -1, 1 << 64), len(words))[at])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _opened(batch: pa.RecordBatch, window: int, groups: int) -> Iterator[tuple[int, Block]]:
    for k in range(batch.num_rows):
        yield batch.column(0)[k].as_py(), Block(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), window, groups)


def packed_windows(blocks: DataFrame, window: int, groups: int) -> DataFrame:
    """(group, block, hashes, ids, counts): distinct windows of each block by group; ``counts`` says how many in a row are of an id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, b in _opened(batch, window, groups):
                out: list[list] = [[], [], [], [], []]
                for g in np.flatnonzero(np.diff(b.cut)).tolist():
                    ship = b.ship[b.cut[g] : b.cut[g + 1]]
                    rows, n = np.unique(b.row[ship], return_counts=True)
                    runs = -(-n // 255)  # a byte counts up to 255
                    counts = np.full(int(runs.sum()), 255, np.uint8)
                    counts[np.cumsum(runs) - 1] = n - 255 * (runs - 1)
                    for c, v in zip(out, (g, number, b.hashes[ship].tobytes(), np.repeat(b.keys[rows], runs).tobytes(), counts.tobytes())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["group", "block", "hashes", "ids", "counts"])

    return blocks.mapInArrow(pack, "group int, block long, hashes binary, ids binary, counts binary")


def later_windows(packed: DataFrame) -> DataFrame:
    """(block, group, bits): windows of ``packed`` that an earlier row holds as well, a bit each in their order; rows with any."""

    def answer(t: pa.Table) -> pa.Table:
        def flat(name: str, kind: str) -> list[np.ndarray]:
            return [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]

        parts = flat("hashes", "<u8")
        hashes = np.concatenate(parts)
        keys = np.repeat(np.concatenate(flat("ids", "<i8")), np.concatenate(flat("counts", "u1")))
        order = np.argsort(hashes)
        h, keys = hashes[order], keys[order]
        new = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        later = np.zeros(len(h), bool)
        later[order] = keys > np.repeat(np.minimum.reduceat(keys, new), np.diff(np.append(new, len(h))))
        ends = np.cumsum([len(p) for p in parts])
        kept = [(b, g, np.packbits(x, bitorder="little").tobytes()) for b, g, x in zip(t.column("block").to_pylist(), t.column("group").to_pylist(), np.split(later, ends[:-1])) if x.any()]
        return pa.table({"block": pa.array([k[0] for k in kept], pa.int64()), "group": pa.array([k[1] for k in kept], pa.int32()), "bits": pa.array([k[2] for k in kept], pa.binary())})

    return packed.groupBy("group").applyInArrow(answer, "block long, group int, bits binary")


def remove_repeats(docs: DataFrame, window: int = 20, groups: int | None = None) -> DataFrame:
    """(doc_id, n_words, removed: array of [start, end) in words, kept_text: kept words, joined by blanks) per row of ``docs``.

    ``groups`` overrides the number of groups of hashes, which follows the bytes of text.
    """
    blocks = text_blocks(docs)
    if groups is None:
        size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda total, x: total + x))).first()[0] or 0
        groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * PACKED / GROUP_BYTES))
    replies = materialize(later_windows(packed_windows(blocks, window, groups)), "replies")
    answers = replies.groupBy("block").agg(F.collect_list(F.struct("group", "bits")).alias("replies"))  # a bit for each window of a block

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (_, b) in enumerate(_opened(batch, window, groups)):
                b.mark({r["group"]: r["bits"] for r in batch.column(4)[k].as_py() or []})
                gone = b.removed()
                ends = np.cumsum(b.words)
                spans, kept = [], []
                for raw, lo, hi in zip(b.raws, (ends - b.words).tolist(), ends.tolist()):
                    words, mask = raw.split(), gone[lo:hi]
                    if mask.any():
                        turn = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                        spans.append([{"start": s, "end": e} for s, e in turn])
                        words = compress(words, (~mask).tolist())
                    else:
                        spans.append([])
                    kept.append(b" ".join(words).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.words.astype(np.int64)), pa.array(spans, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "removed", "kept_text"])

    joined = blocks.join(answers, "block", "left").select("block", "ids", "sizes", "texts", "replies")
    return joined.mapInArrow(cut, "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept_text string")


def removal_digests(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of ``remove_repeats``."""
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return remove_repeats(docs, window).select("doc_id", "n_words", n.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
