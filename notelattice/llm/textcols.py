"""Vectorised helpers over Arrow text columns: word spans, rolling hashes and shingles.

Texts are handled as UTF-8 bytes in slices of a bounded size, so memory follows the slice and the longest
single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_INV = pow(_STEP, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:  # very long texts don't enlarge what the worker keeps
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets) for runs of rows of about SLICE_BYTES; a null has no bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) else col.type).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 2500) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of at most ``rows`` rows, so that what is derived from them stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; ``lower`` folds A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    vals = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(vals * _power(_STEP, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _MULT)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles and their rows, sorted by row; a row with fewer words has one shingle of all."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(rows, minlength=n_rows)
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        h = mix(h * _MULT + words[k : k + len(h)] + np.uint64(k + 1))
    same = rows[: len(h)] == rows[n - 1 :] if len(h) else np.zeros(0, bool)
    h, r = h[same], rows[: len(same)][same]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(counts)])
        extra = []
        for row in short:
            x = np.zeros(1, np.uint64)
            for w in words[begin[row] : begin[row + 1]]:
                x = mix(x * _MULT + w)
            extra.append(x[0] ^ np.uint64(counts[row]))
        h, r = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r
