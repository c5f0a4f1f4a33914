"""Ranked lexical search by scanning texts with an Aho-Corasick automaton of all item terms.

There is no index of documents. Items are dealt into blocks of about BLOCK_BYTES of text, and for each block

1. its distinct terms go into one automaton, each between two guards (a byte that stands for all separators), so that only
   whole terms match; automaton and the map from its outputs to items are broadcast, bounded by the block;
2. a first scan of all texts counts, per task, the documents that hold each term, and the documents' terms in all;
3. a second scan finds each document's term counts again, adds up the scores of the items that its terms map to, and keeps
   the ``k`` best documents of each item per task; two windows then leave ``k`` per item.

So nothing of a document leaves its task but at most ``k`` rows per item. Scores are whole numbers.

Terms are the maximal runs of ASCII letters, ASCII digits and characters beyond ASCII; only A-Z are lower-cased. Null and
empty texts have no terms: such documents are not found and do not count, such items have no row. Items that share an id,
null included, are one item whose terms add up. Documents that share an id are ranked apart; a null id comes last among
equal scores. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import materialize
from .textcols import LOWER, byte_slices, row_slices

#: Bytes of items whose terms share an automaton, about; an item is never cut.
BLOCK_BYTES = 8 << 20
#: Document-item pairs whose scores are added up at a time.
PAIRS = 1 << 20
#: BM25's constants: k1 is 1.2 in eighths of the length factor, b is 0.75.
B_PERCENT = 75
_GUARD = "\0"
#: Bytes of texts as they are scanned: separators become the guard, A-Z lower case.
FOLD = LOWER.copy()
FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0


def folded_terms(text: str) -> list[str]:
    """Terms of ``text``, with a character per byte."""
    return FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("latin-1").replace(_GUARD, " ").split(" ")


class ItemBlock:
    """The terms of some items: an automaton over them, and for each term the items that hold it and how often."""

    def __init__(self, texts: dict[object, list[str]]):
        import ahocorasick

        self.ids = list(texts)
        number: dict[str, int] = {}
        posts: list[list[tuple[int, int]]] = []
        for item, parts in enumerate(texts.values()):
            for term, n in Counter(t for part in parts for t in folded_terms(part) if t).items():
                if term not in number:
                    number[term] = len(number)
                    posts.append([])
                posts[number[term]].append((item, n))
        self.terms = len(number)
        self.start = np.cumsum([0, *map(len, posts)])
        flat = np.array(list(chain.from_iterable(posts)), np.int64).reshape(-1, 2)
        self.item, self.times = flat[:, 0], flat[:, 1]
        self.automaton = ahocorasick.Automaton()
        for term, k in number.items():
            self.automaton.add_word(f"{_GUARD}{term}{_GUARD}", k)
        if number:
            self.automaton.make_automaton()

    def counts(self, raw: bytes) -> Counter:
        """How often each term occurs in a folded text."""
        return Counter(map(itemgetter(1), self.automaton.iter(f"{_GUARD}{raw.decode('latin-1')}{_GUARD}")))


def _scan(block: ItemBlock, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, list[Counter]]]:
    """(batch, first row, number of terms of each row, counts of the block's terms in each row) for slices of batches."""
    for batch in row_slices(batches):
        texts = pa.RecordBatch.from_arrays([batch.column(column)], ["text"])
        for i, j, data, offsets in byte_slices(texts):
            data = FOLD[data]
            first = data != 0
            begin = np.zeros(len(data) + 1, bool)
            begin[offsets[:-1]] = True
            first[1:] &= (data[:-1] == 0) | begin[1:-1]
            before = np.concatenate([[0], np.cumsum(first)])
            raw = data.tobytes()
            yield batch, i, np.diff(before[offsets]), [block.counts(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _document_counts(docs: DataFrame, block: Broadcast) -> DataFrame:
    """(term, n): documents that hold each term of the block; term -1: documents with a term, -2: their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.value.terms + 2, np.int64)
        for _, _, size, found in _scan(block.value, batches, 0):
            hits = Counter(chain.from_iterable(found))
            total[np.fromiter(hits, np.int64, len(hits))] += np.fromiter(hits.values(), np.int64, len(hits))
            total[-1] += int((size > 0).sum())
            total[-2] += int(size.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at < len(total) - 2, at, at - len(total))), pa.array(total[at])], ["term", "n"])

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _best(docs: DataFrame, block: Broadcast, weight: Broadcast, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the ``k`` best documents of each of the block's items within each task."""

    def scores(size: np.ndarray, found: list[Counter]) -> np.ndarray:
        b = block.value
        doc = np.repeat(np.arange(len(found)), [len(c) for c in found])
        term = np.fromiter(chain.from_iterable(found), np.int64, len(doc))
        tf = np.fromiter(chain.from_iterable(c.values() for c in found), np.int64, len(doc))
        m = 100 - B_PERCENT + (B_PERCENT * size * n_docs) // n_terms
        value = weight.value[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        n = b.start[term + 1] - b.start[term]
        at = np.repeat(b.start[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = np.zeros(len(found) * len(b.ids), np.int64)
        np.add.at(out, np.repeat(doc, n) * len(b.ids) + b.item[at], np.repeat(value, n) * b.times[at])
        return out.reshape(len(found), len(b.ids))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        held: list[list[tuple[int, bool, int]]] = [[] for _ in b.ids]  # heaps of (score, has an id, -id)
        least = np.ones(len(b.ids), np.int64)
        step = max(1, PAIRS // max(1, len(b.ids)))
        for batch, i, size, found in _scan(b, batches, 1):
            for lo in range(0, len(found), step):
                got = scores(size[lo : lo + step], found[lo : lo + step])
                for row, item in zip(*(x.tolist() for x in np.nonzero(got >= least))):
                    heap, doc_id = held[item], batch.column(0)[i + lo + row].as_py()
                    entry = (int(got[row, item]), doc_id is not None, -(doc_id or 0))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        least[item] = heap[0][0]
        rows = [(item, -e[2] if e[1] else None, e[0]) for item, heap in enumerate(held) for e in heap]
        for lo in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + 10_000])], ["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rank, "item long, doc_id long, score long")


def _leading(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group, numbered."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    named = items.where("length(text) > 0").select("item_id", "text", F.octet_length("text").alias("bytes"))
    size = named.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = []
    for number in range(blocks):
        texts: dict[object, list[str]] = {}
        for row in named.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).select("item_id", "text").collect():  # about BLOCK_BYTES
            texts.setdefault(row.item_id, []).append(row.text)
        if not texts:
            continue
        held = ItemBlock(texts)
        if not held.terms:
            continue
        block = spark.sparkContext.broadcast(held)
        counted = {r.term: r.n for r in _document_counts(docs, block).collect()}  # a row per term of the block at most
        n_docs, n_terms = counted.get(-1, 0), counted.get(-2, 0)
        if not n_docs:
            break  # no document has a term
        df = np.array([counted.get(t, 0) for t in range(held.terms)], np.int64)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = _best(docs, block, spark.sparkContext.broadcast(weight), n_docs, n_terms, k)
        found = _leading(found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(parts))), ["item", "salt"], k).drop("salt", "rank")
        ids = spark.createDataFrame([(j, x) for j, x in enumerate(held.ids)], f"item long, item_id {dict(items.dtypes)['item_id']}")
        out.append(materialize(_leading(found, ["item"], k).join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "found"))
    if not out:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole
