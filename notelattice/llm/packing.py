"""Packing documents into training sequences along a space-filling curve.

1. Each document is tokenized and gets an end id. Its token counts are hashed into HASHED bins, log-scaled, normalised
   and projected to DIMS dimensions, which are quantised to LEVELS bits and turned into a Hilbert key.
2. Documents are range-sorted by (key, doc_id, row), so neighbours on the curve are neighbours in the order and equal
   keys split over partitions.
3. The tokens of all documents in that order form one stream that is cut every ``length`` ids; a document is cut
   freely, and each id lies in exactly one piece. Only the last sequence can be short; it would be padded to
   ``length`` by whoever writes the sequences, unless it holds a power of two of ids.

A null or empty text is one end id. Repeated rows are packed each. Null ids sort first; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .ordering import running_starts
from .scratch import materialize
from .tokens import CACHE, SMALL_CACHE, chunk_table, small_slices, with_ends

HASHED = 1024
DIMS = 3
LEVELS = 10
SEED = 11


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer ``points`` (n, dims) below 2**bits, most significant axis first.

    Axes are untangled plane by plane: where an axis has the plane's bit, the lower bits of the first axis flip, else
    they swap with that axis; a Gray code over the axes then gives the key.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for a in range(n):
            on = (x[:, a] & plane) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, a]) & low)
            x[:, 0] = np.where(on, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, a] ^= swap
        plane >>= 1
    for a in range(1, n):
        x[:, a] ^= x[:, a - 1]
    fix = np.zeros(len(x), np.int64)
    plane = 1 << (bits - 1)
    while plane > 1:
        fix ^= np.where((x[:, n - 1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= fix[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for a in range(n):
            key = (key << 1) | ((x[:, a] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents: ``ids`` of all in a row, ``begin`` where each starts, the end included."""
    n = len(begin) - 1
    rng = np.random.default_rng(SEED)
    project = rng.standard_normal((HASHED, DIMS))
    h = (ids.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
    sign = 1.0 - 2.0 * ((h >> np.uint64(5)) & np.uint64(1)).astype(float)
    at = np.repeat(np.arange(n) * HASHED, np.diff(begin)) + (h >> np.uint64(22)).astype(np.int64)
    v = np.bincount(at, sign, n * HASHED).reshape(n, HASHED)
    v = np.copysign(np.log1p(np.abs(v)), v)
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    # a sum by row and bin in a fixed order, so that a key doesn't depend on the rows beside it
    z = np.stack([(v * project[:, d]).sum(1) for d in range(DIMS)], 1) / np.where(norm > 0, norm, 1)[:, None]
    top = (1 << LEVELS) - 1
    return hilbert_key(np.clip((1 / (1 + np.exp(-1.7 * z)) * (1 << LEVELS)).astype(np.int64), 0, top), LEVELS)


def tokenized(docs: DataFrame, path: str, end_id: int, keep: bool = True) -> DataFrame:
    """row (unique), doc_id, n_tokens, curve (Hilbert key), ids (compressed little-endian unsigned 16- or 32-bit).

    ``keep``: workers keep the chunks they have met for later tasks, which saves time; without, they keep fewer and only
    within a task, which leaves memory for what else runs in the application.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_table(path, "word")
        tokens.limit = CACHE if keep else SMALL_CACHE
        width = "<u2" if tokens.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else "<u4"
        row = TaskContext.get().partitionId() << 33
        squeeze = zstandard.ZstdCompressor(3)
        for whole in batches:
            for batch in small_slices(whole, 1):
                found, begin = tokens.column_ids(batch.column(1))
                ids, begin = with_ends(found, begin, end_id)
                raw, step = ids.astype(width).tobytes(), int(width[-1])
                blobs = [squeeze.compress(raw[i:j]) for i, j in zip((step * begin[:-1]).tolist(), (step * begin[1:]).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(blobs))), batch.column(0), pa.array(np.diff(begin)), pa.array(curve_keys(ids, begin)), pa.array(blobs, pa.binary()), pa.array([width] * len(blobs))], ["row", "doc_id", "n_tokens", "curve", "ids", "width"])
                row += len(blobs)
        if not keep:
            tokens.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "row long, doc_id long, n_tokens long, curve long, ids binary, width string")


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096, digest: bool = True, keep: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32 (or ids), doc_tokens, sequence_id, offset; see the module's text."""
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, path, end_id, keep), "packed-tokens")
    placed, starts = running_starts(tokens.select("curve", "doc_id", "row", "n_tokens"), ["curve", "doc_id", "row"], "n_tokens", ["row"])
    base = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            at = base.value[batch.column(3).to_numpy()] + batch.column(4).to_numpy()
            for doc, blob, width, begin in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), at.tolist()):
                ids = np.frombuffer(zstandard.decompress(blob.as_buffer()), width).astype("<u4")
                n, done = len(ids), 0
                while done < n:
                    take = min(n - done, length - (begin + done) % length)
                    raw = ids[done : done + take].tobytes()
                    for c, v in zip(out, (doc, done, take, zlib.crc32(raw) if digest else raw, n, (begin + done) // length, (begin + done) % length)):
                        c.append(v)
                    done += take
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"])

    last = "ids_crc32 long" if digest else "ids binary"
    joined = tokens.select("row", "doc_id", "ids", "width").join(placed, "row").select("doc_id", "ids", "width", "part", "local")
    return joined.mapInArrow(cut, f"doc_id long, start long, length long, {last}, doc_tokens long, sequence_id long, offset long")
