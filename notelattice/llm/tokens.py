"""Encoding with public tokenizer files, one distinct chunk of text at a time.

A text is cut at white space into chunks that the tokenizer's own splitting never crosses, so the ids of a text are
the ids of its chunks in order. Workers keep the ids of chunks they have met, up to CACHE chunks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHE = 800_000
SMALL_CACHE = 150_000
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space and what follows up to the next white space: cuts before white space only.
_BYTE_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD_END = "</w>"
_tables: dict[tuple[str, str], "ChunkTable"] = {}


def word_chunks(raw: bytes) -> list[bytes]:
    """Chunks for a lower-casing tokenizer that drops white space. Texts that may hold a special token keep their case."""
    return raw.split() if b"<|" in raw else raw.lower().split()


def byte_chunks(text: str) -> list[str]:
    """Chunks for a byte-level tokenizer whose words take one blank in front."""
    return _BYTE_CHUNK.findall(text)


#: White space beyond ASCII; texts with it are cut by the pattern above.
_WIDE_WS = re.compile(b"|".join(sorted({c.encode() for c in re.findall(f"[{_WS}]", "".join(map(chr, range(128, 0x3001))))})))
_IS_WS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def cut_chunks(raws: list[bytes], kind: str) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts in a row, as ``word_chunks`` or ``byte_chunks`` cut ASCII white space, and how many each text has."""
    if kind == "word":
        raws = [raw if b"<|" in raw else raw.lower() for raw in raws]
    data = np.frombuffer(b"".join(raws), np.uint8)
    begin = np.cumsum([0, *map(len, raws)])
    ws = _IS_WS[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[begin] = True
    if kind == "word":
        starts[:-1] &= ~ws  # of texts that begin with a word
        starts[1:-1] |= ws[:-1] & ~ws[1:]
    else:
        starts[1:-1] |= ws[1:] & ~ws[:-1]
    at = np.flatnonzero(starts[:-1])
    sizes = np.diff(np.searchsorted(at, begin))
    if kind == "word":
        at, data = (np.cumsum(~ws) - 1)[at], data[~ws]
    offsets = np.append(at, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]), sizes


class _Codes(dict):
    """Numbers of chunks, given as they come."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, chunk) -> int:
        code = self[chunk] = len(self)
        self.fresh.append(chunk)
        return code


class ChunkTable:
    """Ids of chunks: chunk number ``c`` has ``size[c]`` ids from place ``start[c]`` of ``flat`` on."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind, self.limit = kind, CACHE
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pieces = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.lengths = np.array([len(x) for x in pieces])  # of a byte-level piece: a character per byte
        self.last = np.array([x.endswith(_WORD_END) for x in pieces])  # of a word
        self.clear()

    def clear(self) -> None:
        self.codes, self.flat, self.start, self.size = _Codes(), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunks of all ``texts`` in a row, how many each chunk has, and where each text begins, the end included."""
        if len(self.codes) > self.limit:
            self.clear()
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(texts)), np.int64)
        self._learn()
        counts = self.size[codes]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self._gather(codes), counts, ends[np.cumsum([0, *map(len, texts)])]

    def column_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` in a row, and where each text begins, the end included. Null is empty.

        Chunks are cut and told apart by Arrow and numpy, so that only distinct ones are Python objects.
        """
        if len(self.codes) > self.limit:
            self.clear()
        raws = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts]
        odd = [self.kind == "byte" and bool(_WIDE_WS.search(raw)) for raw in raws]
        chunks, sizes = cut_chunks([b"" if o else raw for o, raw in zip(odd, raws)], self.kind)
        coded = chunks.dictionary_encode()
        distinct = np.fromiter(map(self.codes.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        codes = distinct[coded.indices.to_numpy()]
        if any(odd):
            by_text = np.split(codes, np.cumsum(sizes)[:-1])
            for k in np.flatnonzero(odd).tolist():
                by_text[k] = np.array([self.codes[c.encode()] for c in byte_chunks(raws[k].decode("utf-8", "replace"))], np.int64)
            codes, sizes = np.concatenate(by_text), np.array([len(x) for x in by_text])
        self._learn()
        ends = np.concatenate([[0], np.cumsum(self.size[codes])])
        return self._gather(codes), ends[np.concatenate([[0], np.cumsum(sizes)])]

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        n = self.size[codes]
        return self.flat[np.repeat(self.start[codes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _keep(self, codes: list[int], flat: np.ndarray, sizes: np.ndarray) -> None:
        at = np.array(codes, np.int64)
        self.start[at] = len(self.flat) + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.flat = np.concatenate([self.flat, flat])

    def _learn(self) -> None:
        """Encode the chunks that are new since the last call."""
        codes = self.codes
        if not codes.fresh:
            return
        pairs: list[int] = []
        joined: list[tuple[int, str]] = []
        rest: list[tuple[int, str]] = []
        for c in codes.fresh:  # grows while it is read
            t = c.decode("utf-8", "replace") if isinstance(c, bytes) else c
            base = t.rstrip(_MARKS)
            if base != t and base[-1:].isalpha() and "<|" not in t:  # marks after a letter are a word of their own
                tail = len(t) - len(base)
                pairs += (codes[c], codes[c[:-tail]], codes[c[-tail:]])
            else:
                (joined if self._joins(t) else rest).append((codes[c], t))
        codes.fresh = []
        more = np.zeros(len(codes) - len(self.size), np.int64)
        self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        for k in range(0, len(joined), 1000):
            part = joined[k : k + 1000]
            found = self._encode_joined([t for _, t in part])
            if found is None:
                rest += part
            else:
                self._keep([c for c, _ in part], *found)
        if rest:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)]
            self._keep([c for c, _ in rest], np.array(list(chain.from_iterable(got)), "<u4"), np.array([len(x) for x in got], np.int64))
        if pairs:
            whole, halves = np.array(pairs).reshape(-1, 3)[:, 0], np.array(pairs).reshape(-1, 3)[:, 1:]
            self._keep(whole, self._gather(halves.ravel()), self.size[halves].sum(1))

    def _joins(self, text: str) -> bool:
        """Whether ``text`` can be encoded together with others: a word of letters, or a chunk that begins with a blank."""
        if self.kind == "word":
            return text.isalpha()
        return text[0] in " \n\t" and len(text) > 1 and text[1] not in _LEADING and "<|" not in text

    def _encode_joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``texts``, encoded as one, which is cheaper, and how many each has; None if they can't be told apart."""
        word = self.kind == "word"
        ids = np.array(self.tokenizer.encode_batch_fast([(" " if word else "").join(texts)], add_special_tokens=False)[0].ids, "<u4")
        if word:
            cut = np.flatnonzero(self.last[ids]) + 1
            if len(cut) != len(texts):  # each text gives a word at least, so here one gives more
                return None
        else:
            cut = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(c.encode()) for c in texts]), "left") + 1
        return ids, np.diff(cut, prepend=0)


_LEADING = frozenset("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))


def chunk_table(path: str, kind: str) -> ChunkTable:
    """The table of this worker process."""
    if (path, kind) not in _tables:
        _tables[path, kind] = ChunkTable(path, kind)
    return _tables[path, kind]


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from which the number of groups or files follows."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def small_slices(batch: pa.RecordBatch, column: int, rows: int = 1000, nbytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and about ``nbytes`` bytes in ``column``, or a single longer text."""
    size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
    i = 0
    while i < batch.num_rows:
        done = int(size[i - 1]) if i else 0
        j = min(i + rows, max(i + 1, int(np.searchsorted(size, done + nbytes, "right"))))
        yield batch.slice(i, j - i)
        i = j


def with_ends(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with ``end_id`` after each text, and where each text then begins."""
    return np.insert(ids, begin[1:], end_id), begin + np.arange(len(begin))
