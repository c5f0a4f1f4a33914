"""Token files with Simple-8b coding.

A file holds chunks of about CHUNK ids. A chunk lists its documents (ids and lengths), a table of its most frequent
token ids, the escaped ids, the word offset of every BLOCK ids and 64-bit words. A word's top 4 bits select how many
codes of which width fill the other 60. Codes are ranks in the table, frequent ids first; code 0 escapes to the next
entry of the escape list. Blocks begin at a word, so all blocks decode side by side.

Layout, little-endian: b"S8BT", u32 part, u32 number of chunk, u64 counts of documents, ids, table, escapes, blocks,
words; then doc ids i64, null flags u8, lengths u32, table u32, escapes u32, offsets u32, words u64. TRAILER ends each
chunk. Files are written in ascending doc_id order, one per range of ids; their number follows the bytes of text.

A null or empty text is the end id alone. Null ids come first; repeated rows are written each; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import materialize, scratch_path
from .tokens import chunk_table, small_slices, text_bytes, with_ends

CHUNK = 1 << 19
FILE_BYTES = 256 << 20  # of text for each file, so a file stays far below the 2 GB that a row can hold
BLOCK = 1024
CODES = 4095
TRAILER = "\n.s8b\n"
MAGIC = b"S8BT"
#: (codes, bits) by selector
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


def pack_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of ``codes`` and the first word of each block; a block's last word may be part empty."""
    n = len(codes)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK + 60, np.uint64)
    padded[:n] = codes
    # widths in rows of a block; zeros after its end, so that a last word may be part empty
    width = np.zeros((blocks, BLOCK + 64), np.int8)
    width[:, :BLOCK] = np.frexp(padded[: blocks * BLOCK].astype(np.float64))[1].reshape(blocks, BLOCK)
    widest = {1: width}  # by power of two: the widest of so many codes from each place
    for p in (2, 4, 8, 16, 32):
        m = widest[p // 2]
        widest[p] = np.maximum(m[:, : m.shape[1] - p // 2], m[:, p // 2 :])
    best = np.full((blocks, BLOCK), len(SELECTORS) - 1, np.int8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        p = 1 << (count.bit_length() - 1)
        np.copyto(best, np.int8(s), where=np.maximum(widest[p][:, :BLOCK], widest[p][:, count - p : count - p + BLOCK]) <= bits)
    best = best.ravel()
    ends = np.minimum((np.arange(blocks * BLOCK) // BLOCK + 1) * BLOCK, n)
    counts = np.array([c for c, _ in SELECTORS])
    at = np.arange(blocks) * BLOCK
    stop = np.minimum(at + BLOCK, n)
    found_at, found_block = [], []
    live = np.flatnonzero(at < stop)
    while len(live):
        found_at.append(at[live])
        found_block.append(live)
        at[live] += counts[best[at[live]]]
        live = live[at[live] < stop[live]]
    begin = np.concatenate(found_at or [np.zeros(0, np.int64)])
    block = np.concatenate(found_block or [np.zeros(0, np.int64)])
    order = np.argsort(begin)
    begin, block = begin[order], block[order]
    pick = best[begin]
    words = np.zeros(len(begin), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(pick == s)
        if not len(mine):
            continue
        word = np.full(len(mine), np.uint64(s) << np.uint64(60), np.uint64)
        for k in range(count):
            spot = begin[mine] + k
            word |= np.where(spot < ends[begin[mine]], padded[spot], 0).astype(np.uint64) << np.uint64(k * bits)
        words[mine] = word
    return words, np.searchsorted(block, np.arange(blocks)).astype("<u4")


def unpack_words(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` codes of ``words``; all blocks at once."""
    out = np.zeros(n, np.uint64)
    pick = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[pick]
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    before = np.concatenate([[0], np.cumsum(counts)])
    start = block * BLOCK + before[:-1] - before[offsets.astype(np.int64)][block]
    stop = np.minimum((block + 1) * BLOCK, n)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(pick == s)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            spot = start[mine] + k
            inside = spot < stop[mine]
            out[spot[inside]] = (words[mine[inside]] >> np.uint64(k * bits)) & mask
    return out


def encode_chunk(part: int, number: int, doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    seen = np.bincount(ids)
    table = np.argsort(-seen, kind="stable")[: min(CODES, int((seen > 0).sum()))]
    code = np.zeros(len(seen), np.uint64)
    code[table] = np.arange(1, len(table) + 1)
    codes = code[ids]
    escapes = ids[codes == 0]
    words, offsets = pack_words(codes)
    nulls = bytes(x is None for x in doc_ids)
    head = MAGIC + np.array([part, number], "<u4").tobytes() + np.array([len(doc_ids), len(ids), len(table), len(escapes), len(offsets), len(words)], "<u8").tobytes()
    return b"".join([head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), nulls, np.array(lengths, "<u4").tobytes(), table.astype("<u4").tobytes(), escapes.astype("<u4").tobytes(), offsets.tobytes(), words.astype("<u8").tobytes()])


def decode_chunks(raw: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(part, number, doc ids, lengths, ids) of each chunk of a file."""
    at = 0
    while at < len(raw):
        if raw[at : at + 4] != MAGIC:
            raise ValueError(f"no chunk at byte {at}")
        part, number = np.frombuffer(raw, "<u4", 2, at + 4)
        docs, n, table_n, escape_n, blocks, words_n = (int(x) for x in np.frombuffer(raw, "<u8", 6, at + 12))
        at += 60

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, count, at)
            at += x.nbytes
            return x

        doc_ids, nulls, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        table, escapes, offsets, words = take("<u4", table_n), take("<u4", escape_n), take("<u4", blocks), take("<u8", words_n)
        codes = unpack_words(words, offsets, n)
        ids = np.concatenate([[0], table]).astype("<u4")[codes.astype(np.int64)]
        ids[codes == 0] = escapes
        end = TRAILER.encode()
        if raw[at : at + len(end)] != end:
            raise ValueError(f"chunk {number} of part {part} is cut off")
        at += len(end)
        yield int(part), int(number), [None if z else int(x) for x, z in zip(doc_ids, nulls)], lengths, ids


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 0) -> None:
    """Encode ``docs`` and write token files to the folder ``out``, in ascending doc_id order."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs) // FILE_BYTES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_table(path, "byte")
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list = []
        lengths: list[int] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_chunk(part, number, doc_ids, lengths, np.concatenate(ids))], pa.binary())], ["chunk"])

        for whole in batches:
            for batch in small_slices(whole, 1):
                found, begin = tokens.column_ids(batch.column(1))
                flat, begin = with_ends(found, begin, end_id)
                ids.append(flat)
                doc_ids += batch.column(0).to_pylist()
                lengths += np.diff(begin).tolist()
                size += len(flat)
                if size >= CHUNK:
                    yield chunk()
                    number, ids, doc_ids, lengths, size = number + 1, [], [], [], 0
        if ids:
            yield chunk()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    # the text sink writes the bytes of a string as they are, and the separator after each
    rows.mapInArrow(encode, "chunk binary").select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", TRAILER).text(out)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, in their order."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                local = 0
                for part, _, doc_ids, lengths, ids in decode_chunks(file.as_buffer().to_pybytes()):
                    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths.astype(np.int64))
                    begin = ends - lengths
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.full(len(ends), part, np.int32)), pa.array(local + begin), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "local", "n_tokens", "ids_crc32"])
                    local += int(ends[-1]) if len(ends) else 0

    files = spark.read.format("binaryFile").load(out).select("content")
    rows = materialize(files.mapInArrow(decode, "doc_id long, part int, local long, n_tokens long, ids_crc32 long"), "token-digests")
    totals = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per file
    starts, total = [0] * (max(totals, default=-1) + 1), 0
    for part in range(len(starts)):
        starts[part], total = total, total + totals.get(part, 0)
    base = spark.sparkContext.broadcast(np.array(starts, np.int64))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = base.value[batch.column(1).to_numpy()] + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), batch.column(3), batch.column(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(shift, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to token files in the scratch folder and read the digests back."""
    spark = docs.sparkSession
    out = scratch_path(spark, "token-files")
    write_token_files(docs, path, out, end_id)
    return read_token_files(spark, out)
