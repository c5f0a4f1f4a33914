"""Quality rules by distribution divergence.

Every document gets two histograms, of character classes and of its language's common words, which are compared
with references of its language by Jensen-Shannon distance (square root of the base-2 divergence, 0 to 1). The
references are the mean histograms of all documents of the language in the table; a document counts once,
whatever its length. Base rules on length and repetition come first.

A document fails where the character distance exceeds CHAR_LIMIT, or both distances together JOINT_LIMIT. Guards:
the first test needs MIN_CHARS characters in words, the second MIN_WORDS words. A null language and one with fewer than MIN_DOCS
documents are compared with the mean of all documents, binned by the common words of all. More than MAX_LANGS languages are
judged in pages of about as many, each with references of its own, so no language goes without and no page grows.
Null ids stay null. Null and empty texts have no words, fail the base rules and are not kept. Repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import materialize
from .textcols import byte_slices, shingle_hashes, span_hashes, word_spans

COMMON = 64
MAX_LANGS = 255
SALTS = 128
MIN_DOCS = 30
MIN_CHARS = 100
MIN_WORDS = 60
CHAR_LIMIT = 0.28
JOINT_LIMIT = 0.56
#: lower case, upper case, digits, blanks, line ends, sentence marks, symbols, beyond ASCII
N_CLASSES = 8


def _classes() -> np.ndarray:
    table = np.full(256, 6, np.int64)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[32, 9, 11, 12]], table[[10, 13]] = 3, 4
    table[[ord(c) for c in ".,;:?!'\"()-"]] = 5
    table[0xC0:] = 7
    table[0x80:0xC0] = 8  # continuation bytes aren't characters
    return table


CLASS = _classes()
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "[#*$%&|<>]"]] = True
SYMBOL[[ord("["), ord("]")]] = False
TRIM = np.zeros(256, bool)
TRIM[[ord(c) for c in ".,;:?!"]] = True


class Slice:
    """Word spans and histograms of a run of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n, self.data, self.offsets = len(offsets) - 1, data, offsets
        self.starts, self.ends, self.rows = word_spans(data, offsets)
        self.words = np.bincount(self.rows, minlength=self.n)

    def chars(self) -> np.ndarray:
        row = np.repeat(np.arange(self.n), np.diff(self.offsets))
        return np.bincount(row * 9 + CLASS[self.data], minlength=self.n * 9).reshape(self.n, 9)[:, :N_CLASSES].astype(float)

    def keys(self) -> np.ndarray:
        """Hashes of the lower-cased words without one mark at their end."""
        cut = self.ends - (TRIM[self.data[self.ends - 1]] & (self.ends - self.starts > 1)) if len(self.ends) else self.ends
        return span_hashes(self.data, self.starts, cut, lower=True)

    def base(self) -> dict[str, np.ndarray]:
        n, data = self.n, self.data
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        sym = np.concatenate([[0], np.cumsum(SYMBOL[data])])
        size = (lead[self.ends] - lead[self.starts]) if len(self.starts) else np.zeros(0, np.int64)
        out = {"n_words": self.words, "word_chars": np.bincount(self.rows, size, n).astype(np.int64), "n_symbols": sym[self.offsets[1:]] - sym[self.offsets[:-1]]}
        raw = data.tobytes()
        dup = np.zeros(n, np.int64)
        for k in range(n):
            lines = [x for x in raw[self.offsets[k] : self.offsets[k + 1]].split(b"\n") if x.strip()]
            dup[k] = len(lines) - len(set(lines))
        out["n_dup_lines"] = dup
        exact = span_hashes(data, self.starts, self.ends, lower=False)
        h, r = shingle_hashes(exact, self.rows, n, 3)
        whole = self.words[r] >= 3 if len(r) else np.zeros(0, bool)
        h, r = h[whole], r[whole]
        repeat = np.zeros(n, np.int64)
        if len(h):
            order = np.lexsort((h, r))
            hs, rs = h[order], r[order]
            again = np.zeros(len(h) + 1, bool)
            again[1:-1] = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
            twice = np.zeros(len(h), bool)
            twice[order] = again[:-1] | again[1:]
            # window k of a document starts at its k-th word
            begin = np.concatenate([[0], np.cumsum(self.words)])[:-1]
            first = np.searchsorted(r, np.arange(n))
            at = begin[r] + np.arange(len(r)) - first[r]
            covered = np.zeros(len(self.rows), bool)
            for k in range(3):
                covered[at[twice] + k] = True
            repeat = np.bincount(self.rows, covered, n).astype(np.int64)
        out["n_repeat_words"] = repeat
        return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Slice]]:
    for i, j, data, offsets in byte_slices(batch):
        yield i, j, Slice(data, offsets)


def _langs(batch: pa.RecordBatch, known: dict[str, int]) -> np.ndarray:
    return np.array([known.get(x, len(known)) for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.int64)


def _spread(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(-1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance in base 2; an empty row has distance 0."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.where(p.sum(-1) > 0, np.sqrt(np.maximum(d, 0) / 2), 0.0)


def _histograms(s: Slice, keys: np.ndarray, lang: np.ndarray, common: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Character and word histograms per document, by ``keys`` of its words; the last word bin is all other words."""
    words = np.zeros((s.n, COMMON + 1))
    at = np.full(len(keys), COMMON, np.int64)
    for k in np.unique(lang):
        mine, list_ = lang[s.rows] == k, common[k]
        if len(list_) and mine.any():
            pos = np.minimum(np.searchsorted(list_, keys[mine]), len(list_) - 1)
            at[mine] = np.where(list_[pos] == keys[mine], pos, COMMON)
    np.add.at(words, (s.rows, at), 1)
    return _spread(s.chars()), _spread(words)


def pages(docs: DataFrame) -> Iterator[tuple[DataFrame, dict]]:
    """``docs`` in parts, each with the references of its languages; one part if there are at most MAX_LANGS languages.

    A language's page follows from its hash, and a null one is on the first. The mean of all documents, which rare languages
    are compared with on every page, is that of the whole table.
    """
    by_lang = docs.where("lang IS NOT NULL AND length(text) > 0").groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    known = [r["lang"] for r in by_lang.orderBy(F.desc("n"), "lang").limit(MAX_LANGS + 1).collect()]
    if len(known) <= MAX_LANGS:
        yield docs, references(docs, known)
        return
    n = 2 * -(-by_lang.count() // MAX_LANGS)  # half full on average, so that none holds many more
    page, whole = F.coalesce(F.pmod(F.xxhash64("lang"), F.lit(n)), F.lit(0)), None
    for k in range(n):
        mine = docs.where(page == k)
        known = [r["lang"] for r in by_lang.where(page == k).orderBy(F.desc("n"), "lang").collect()]
        ref = references(mine if k else docs, known)
        whole = whole or ref
        yield mine, ref | {x: [*ref[x][:-1], whole[x][-1]] if x == "common" else np.vstack([ref[x][:-1], whole[x][-1:]]) for x in ("common", "chars", "words")}


def references(docs: DataFrame, langs: list[str]) -> dict:
    """Per language of ``langs``: common words (by documents' use, then hash) and mean histograms; the last entry is all documents,
    those of known languages too.

    Two passes of whole-table aggregates. What the driver holds is bounded by the number of ``langs`` times COMMON + bins.
    """
    spark = docs.sparkSession
    known = {x: k for k, x in enumerate(langs)}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = _langs(batch, known)
            keys, langs = [], []
            for i, j, s in _slices(batch):
                k, r = s.keys(), s.rows
                order = np.lexsort((k, r))
                k, r = k[order], r[order]
                new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])] if len(k) else np.zeros(0, bool)
                keys.append(k[new])
                langs.append(lang[i:j][r[new]])
            if not keys:
                continue
            k, g = np.concatenate(keys), np.concatenate(langs)
            for one in {*g.tolist(), len(known)}:
                h, c = np.unique(k if one == len(known) else k[g == one], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), one, np.int32)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "word", "n"])

    counts = docs.select("lang", "text").mapInArrow(words, "lang int, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the top of each of SALTS parts of a language first, so that no task holds all words of one
    part = F.pmod(F.xxhash64("word"), F.lit(SALTS))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy(F.desc("n"), "word"))).where(F.col("k") <= COMMON)
    top = top.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= COMMON)
    found = top.select("lang", "word").collect()
    common = [np.sort(np.array([r["word"] for r in found if r["lang"] == k], np.int64).view(np.uint64)) for k in range(len(known) + 1)]
    width = N_CLASSES + COMMON + 1

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(known) + 1, width)), np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            lang = _langs(batch, known)
            for i, j, s in _slices(batch):
                keys, some = s.keys(), s.words > 0
                every = np.full(s.n, len(known))
                for g, rows in ((lang[i:j], some & (lang[i:j] < len(known))), (every, some)):
                    c, w = _histograms(s, keys, g, common)
                    # fixed point, so that the sum doesn't depend on the order of tasks
                    np.add.at(total, g[rows], np.round(np.concatenate([c, w], 1)[rows] * 2**24))
                    n += np.bincount(g[rows], minlength=len(n))
        keys = np.arange(len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, width).astype(np.int32)), pa.array(np.tile(np.arange(width), len(n)).astype(np.int32)), pa.array(total.ravel().astype(np.int64)), pa.array(np.repeat(n, width))], ["lang", "bin", "s", "n"])

    sums = docs.select("lang", "text").mapInArrow(means, "lang int, bin int, s long, n long").groupBy("lang", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    ref = np.zeros((len(known) + 1, width))
    for r in sums:
        ref[r["lang"], r["bin"]] = r["s"]
    return {"known": known, "common": common, "chars": _spread(ref[:, :N_CLASSES]), "words": _spread(ref[:, N_CLASSES:])}


def _verdicts(batch: pa.RecordBatch, ref: dict, char_limit: float, joint_limit: float) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    lang = _langs(batch, ref["known"])
    for i, j, s in _slices(batch):
        b, g = {k: np.asarray(v, np.int64) for k, v in s.base().items()}, lang[i:j]
        c, w = _histograms(s, s.keys(), g, ref["common"])
        dc, dw = js_distance(c, ref["chars"][g]), js_distance(w, ref["words"][g])
        failed = (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
        far = ((dc > char_limit) & (b["word_chars"] >= MIN_CHARS)) | ((dc + dw > joint_limit) & (b["n_words"] >= MIN_WORDS))
        yield i, j, b | {"base_failed": failed, "char_distance": dc, "word_distance": dw, "kept": ~failed & ~far}


def _paged(docs: DataFrame, pick: Callable[[DataFrame], DataFrame], judge: Callable, schema) -> DataFrame:
    """``judge(references, batches)`` of the picked columns of each page of ``docs``."""
    out = None
    for part, ref in pages(docs):
        one = pick(part).mapInArrow(partial(judge, docs.sparkSession.sparkContext.broadcast(ref)), schema)
        out = one if out is None else out.union(one)
    return out


def kept_rows(docs: DataFrame, char_limit: float = CHAR_LIMIT, joint_limit: float = JOINT_LIMIT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""

    def keep(ref, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b["kept"] for _, _, b in _verdicts(batch, ref.value, char_limit, joint_limit)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return _paged(docs, lambda part: part, keep, docs.schema)


def quality_rules(docs: DataFrame, char_limit: float = CHAR_LIMIT, joint_limit: float = JOINT_LIMIT) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances and kept, per row of ``docs`` (doc_id, text, lang)."""

    def judge(ref, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b in _verdicts(batch, ref.value, char_limit, joint_limit):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x) for x in b.values())], ["doc_id", *b])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return _paged(docs, lambda part: part.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), judge, schema)
