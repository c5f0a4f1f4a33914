"""BPE encoding and decoding with a distinct-word table.

1. Texts are split at white space. Documents are gathered in blocks of about BLOCK_BYTES; a block lists its distinct
   words and, for each document, the positions of its words in that list. Rows must come in the same order each time
   they are read, as they do from files.
2. The words of all blocks are dealt by hash to tasks that encode each distinct word once.
3. The ids go back to the blocks by (block, word position), and each document's ids are joined up by position.
4. The distinct ids of each list of words are joined with the id-to-piece table, which is broadcast: it is as large as
   the vocabulary and no larger. A block joins the pieces it got as the library does for tokenizers without a decoder:
   by a blank.

Words are dealt in groups whose number follows the bytes of text, so a group does not grow with the input. Only the distinct words of a block travel, never its words in full, and a frequent word is one entry per block. A
null or empty text has no ids and decodes to an empty text. Repeated rows and ids are encoded each; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from .tokens import chunk_table, text_bytes, word_chunks

BLOCK_BYTES = 12 << 20
GROUP_BYTES = 32 << 20  # of text for each group of words
LEAST_GROUPS = 128
_CODED = "block long, part int, blob binary"


def _pack(*arrays: bytes) -> bytes:
    head = np.array([len(a) for a in arrays], "<u8").tobytes()
    return zstandard.compress(head + b"".join(arrays), 3)


def _unpack(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(blob)
    ends = np.cumsum(np.frombuffer(raw[: 8 * n], "<u8").astype(np.int64)) + 8 * n
    return [raw[a:b] for a, b in zip([8 * n, *ends[:-1]], ends)]


def split_words(docs: DataFrame, parts: int, words: bool) -> DataFrame:
    """Blocks, either their distinct ``words`` by part, or their documents: ids, words per document, word positions.

    A block's key is a digest of its content, so both halves can be computed apart; positions are ranks by frequency.
    """

    def block(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        index: dict[bytes, int] = {}
        at = np.array([index.setdefault(w, len(index)) for doc in texts for w in doc], np.int64)
        order = np.argsort(-np.bincount(at, minlength=len(index)), kind="stable")
        found = list(index)
        names = [found[k] for k in order]
        doc_ids = pa.array(ids, pa.int64()).fill_null(0).to_numpy().astype("<i8").tobytes()
        key = int.from_bytes(hashlib.blake2b(b"\n".join([doc_ids, *names]), digest_size=8).digest(), "little", signed=True)
        part = np.array([zlib.crc32(w) % parts for w in names], np.int64)
        if words:
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(parts + 1))
            rows = [(p, zstandard.compress(b"\n".join([names[k] for k in by[cut[p] : cut[p + 1]]]), 3)) for p in range(parts) if cut[p + 1] > cut[p]]
        else:
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            planes = rank[at].view("u1").reshape(-1, 4).T  # bytes of like weight together compress best
            rows = [(-1, _pack(doc_ids, bytes(x is None for x in ids), np.array([len(d) for d in texts], "<u4").tobytes(), part.astype("<u2").tobytes(), *(x.tobytes() for x in planes)))]
        return pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "part", "blob"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids.append(i)
                texts.append(word_chunks(raw))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield block(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, _CODED)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """For each (block, part) of words a row with the ids of each word, counts before ids, and a row per distinct id."""

    def encode(table: pa.Table) -> pa.Table:
        lists = [zstandard.decompress(b.as_buffer()).split(b"\n") for b in table.column("blob")]
        tokens = chunk_table(path, "word")
        tokens.clear()  # each task has words of its own
        flat, counts, begin = tokens.ids(lists)
        first = np.cumsum([0, *map(len, lists)])
        blobs = [_pack(counts[i:j].astype("<u4").tobytes(), flat[a:b].tobytes()) for i, j, a, b in zip(first[:-1], first[1:], begin[:-1], begin[1:])]
        found = [np.unique(flat[a:b]) for a, b in zip(begin[:-1], begin[1:])]
        tokens.clear()
        coded = pa.table({"block": table.column("block"), "part": table.column("part"), "blob": pa.array(blobs, pa.binary())})
        blocks = np.repeat(table.column("block").to_numpy(), [len(x) for x in found])
        ids = pa.table({"block": pa.array(blocks, pa.int64()), "id": pa.array(np.concatenate(found).astype(np.int32), pa.int32())})
        return pa.concat_tables([coded, ids], promote_options="default")

    return words.groupBy("part").applyInArrow(encode, f"{_CODED}, id int")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece in UTF-8) of the whole vocabulary."""
    tokenizer = Tokenizer.from_file(path)
    vocabulary = [(i, t) for i in range(tokenizer.get_vocab_size()) if (t := tokenizer.id_to_token(i)) is not None]
    return spark.createDataFrame(vocabulary, "id int, piece string").select("id", F.col("piece").cast("binary").alias("piece"))


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit, pieces binary: the decoded text) per row of ``docs``."""
    return _joined(docs, path, lambda ids, text: (ids, text), "ids binary, pieces binary", (pa.binary(), pa.binary()))


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``."""
    return _joined(docs, path, lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()), "n_tokens long, ids_sha256 string, decoded_sha256 string", (pa.int64(), pa.string(), pa.string()))


def _joined(docs: DataFrame, path: str, result, schema: str, types: tuple) -> DataFrame:
    spark = docs.sparkSession
    parts = min(max(LEAST_GROUPS, text_bytes(docs) // GROUP_BYTES), 65535)
    ids = encode_words(split_words(docs, parts, words=True), path).join(F.broadcast(pieces(spark, path)), "id", "left")
    names = [x.split()[0] for x in schema.split(", ")]

    def join(rows_: pa.Table) -> Iterator[pa.RecordBatch]:
        is_id = pc.is_valid(rows_.column("id"))
        known, table = rows_.filter(is_id), rows_.filter(pc.invert(is_id))
        known_ids, first = np.unique(known.column("id").to_numpy(), return_index=True)
        piece = dict(zip(known_ids.tolist(), known.column("piece").take(pa.array(first)).to_pylist()))
        part, blobs = table.column("part").to_numpy(), table.column("blob")
        coded = {int(p): blobs[k].as_buffer() for k, p in enumerate(part) if p >= 0}
        for k in np.flatnonzero(part < 0):  # more than one only if blocks are equal
            doc_ids, nulls, sizes, parts_, *planes = _unpack(blobs[int(k)].as_py(), 8)
            by = np.argsort(np.frombuffer(parts_, "<u2"), kind="stable")
            lists = [_unpack(coded[p], 2) for p in np.unique(np.frombuffer(parts_, "<u2")).tolist()]
            raw = b"".join(x for _, x in lists)
            ends = 4 * np.cumsum(np.frombuffer(b"".join(c for c, _ in lists), "<u4").astype(np.int64))
            words: list[bytes] = [b""] * len(by)
            for rank, a, b in zip(by.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                words[rank] = raw[a:b]
            text = [b" ".join([piece[x] for x in np.frombuffer(w, "<u4").tolist()]) for w in words]
            at = np.stack([np.frombuffer(x, "u1") for x in planes], 1).copy().view("<u4").ravel().tolist()
            ids_ = pa.array(np.frombuffer(doc_ids, "<i8"), mask=np.frombuffer(nulls, bool))
            rows, done, first = [], 0, 0
            for n, size in enumerate(np.frombuffer(sizes, "<u4").tolist()):
                mine = at[done : done + size]
                done += size
                rows.append(result(b"".join([words[w] for w in mine]), b" ".join([t for t in [text[w] for w in mine] if t])))
                if len(rows) == 1000 or n + 1 == len(ids_):
                    yield pa.RecordBatch.from_arrays([ids_.slice(first, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["doc_id", *names])
                    rows, first = [], n + 1

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(join(table)))

    blocks = split_words(docs, parts, words=False)
    return blocks.unionByName(ids, allowMissingColumns=True).groupBy("block").applyInArrow(whole, f"doc_id long, {schema}")
