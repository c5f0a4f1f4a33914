"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(x . w - theta_k) with one weight vector for all ordered thresholds theta_0 < theta_1 < ...;
x holds 1 for each selected feature that a text contains: hashed words and hashed 4- and 5-byte windows of words,
lower case. The expected severity is the sum of P(grade > k) over k.

Features are the FEATURES ones with the largest chi-square among those LIFT times more frequent in toxic rows.
Fitting uses a bounded sample: the SAMPLE labelled rows with the smallest hash of their id. Scoring uses all rows
and whole texts. Labels say 0 or 1 only, so grades are derived: 0 for clean rows; toxic rows are graded 1 to 3 by
the tercile of how many different marker features they hold. A ``severity`` column in the labels (0 to 3) is used
instead where present.

A null or empty text has no features and gets the severity of the thresholds alone, which is near 0. Labels without
a document, null labels and repeated label rows are harmless (the largest label of an id counts). If the labels hold
one class only, or none, every document gets severity 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import materialize
from .textcols import byte_slices, span_hashes, word_spans

SAMPLE = 16_000
FEATURES = 4096
BINS = 1 << 22
GRADES = 4
WINDOWS = (4, 5)
#: Smallest chi-square statistic of a selected feature.
SIGNIFICANT = 16.0
#: How many times more often, at least, toxic rows hold a selected feature.
LIFT = 4.0
CUTOFF = 0.35


def feature_hits(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every occurrence; all bins if ``table`` is None, else selected ones."""
    starts, ends, rows = word_spans(data, offsets)
    shift = np.uint64(64 - 22)
    found_r, found_f = [], []

    def add(h: np.ndarray, r: np.ndarray) -> None:
        f = (h >> shift).astype(np.int64)
        if table is not None:
            f = table[f]
            keep = f >= 0
            f, r = f[keep], r[keep]
        found_f.append(f)
        found_r.append(r)

    add(span_hashes(data, starts, ends, lower=True), rows)
    for width in WINDOWS:
        long = ends - starts >= width
        s, e, r = starts[long], ends[long], rows[long]
        count = e - s - width + 1
        if len(s):
            at = np.repeat(s - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
            add(span_hashes(data, at, at + width, lower=True), np.repeat(r, count))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_r or none), np.concatenate(found_f or none).astype(np.int64)


def _distinct(rows: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(rows * BINS + feats)
    return key // BINS, key % BINS


def fit_ordinal(rows: np.ndarray, feats: np.ndarray, grade: np.ndarray, width: int, penalty: float = 0.002, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative logit model by penalised maximum likelihood (Adam).

    ``rows``, ``feats``: coordinates of the ones of the feature matrix. Thresholds are theta_0 and positive gaps.
    """
    n, cuts = len(grade), GRADES - 1
    w, par = np.zeros(width), np.r_[1.0, np.zeros(cuts - 1)]
    m = v = np.zeros(width + cuts)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[feats], n)
        theta = par[0] + np.r_[0.0, np.cumsum(np.exp(par[1:]))]
        up = 1 / (1 + np.exp(-np.clip(z[:, None] - theta, -35, 35)))  # P(grade > k)
        full = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], 1)
        at = np.arange(n)
        p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))], 1)
        dz = -(slope[at, grade] - slope[at, grade + 1]) / p
        dt = np.zeros((n, cuts + 2))
        dt[at, grade] += slope[at, grade] / p
        dt[at, grade + 1] -= slope[at, grade + 1] / p
        dtheta = dt[:, 1:-1].sum(0)
        back = np.cumsum(dtheta[::-1])[::-1]
        g = np.r_[np.bincount(feats, dz[rows], width) + penalty * n / 100 * w, back[0], back[1:] * np.exp(par[1:])] / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, par = w - move[:width], par - move[width:]
    return w, par[0] + np.r_[0.0, np.cumsum(np.exp(par[1:]))]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Selected features, weights and thresholds; what the driver holds is bounded by SAMPLE and FEATURES."""
    graded = "severity" in labels.columns
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("severity") if graded else F.col("toxic")).cast("int").alias("y")).dropna()
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    sample = materialize(texts.join(F.broadcast(lab), "doc_id").dropDuplicates(["doc_id"]), "labelled")  # at most SAMPLE ids
    empty = {"table": None, "w": None, "theta": None}
    sizes = {bool(r["t"]): r["n"] for r in sample.groupBy((F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return empty

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy() > 0
            for i, j, data, offsets in byte_slices(batch):
                r, f = feature_hits(data, offsets, None)
                r, f = _distinct(r, f)
                b, at = np.unique(f, return_inverse=True)
                t = np.bincount(at, y[i:j][r], len(b)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(t), pa.array(np.bincount(at, minlength=len(b)) - t)], ["bin", "toxic", "clean"])

    nt, nc = sizes[True], sizes[False]
    seen = sample.select("doc_id", "y", "text").mapInArrow(bins, "bin long, toxic long, clean long").groupBy("bin").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t + c >= 3")
    a, b, c, d = F.col("t").cast("double"), F.col("c").cast("double"), F.lit(float(nt)) - F.col("t"), F.lit(float(nc)) - F.col("c")
    chi = (a * d - b * c) ** 2 / ((a + b) * (c + d + 1) * float(nt) * float(nc))
    lift = ((F.col("t") + 0.5) / nt) / ((F.col("c") + 0.5) / nc)
    chosen = seen.where((chi * float(nt + nc) >= SIGNIFICANT) & (lift > LIFT)).orderBy(chi.desc(), "bin").limit(FEATURES).select("bin", (lift > 20).alias("marker")).toPandas()
    chosen = chosen.sort_values("bin")
    table = np.full(BINS, -1, np.int32)
    table[chosen["bin"].to_numpy()] = np.arange(len(chosen))
    marker = chosen["marker"].to_numpy(bool)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in byte_slices(batch):
                r, f = feature_hits(data, offsets, shared.value)
                r, f = _distinct(r, f)
                cut = np.searchsorted(r, np.arange(j - i + 1))
                feats = [f[cut[k] : cut[k + 1]] for k in range(j - i)]
                marks = np.bincount(r, marker[f], j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(feats, pa.list_(pa.int64())), pa.array(marks.astype(np.int64))], ["doc_id", "y", "feats", "marks"])

    rows = sample.select("doc_id", "y", "text").mapInArrow(ones, "doc_id long, y int, feats array<long>, marks long").orderBy("doc_id").toPandas()
    y = rows["y"].to_numpy(np.int64)
    if graded:
        grade = np.clip(y, 0, GRADES - 1)
    else:
        marks = rows["marks"].to_numpy()
        grade = np.where(y > 0, 1 + np.searchsorted(np.quantile(marks[y > 0], [1 / 3, 2 / 3]), marks), 0)
    lens = rows["feats"].map(len).to_numpy()
    w, theta = fit_ordinal(np.repeat(np.arange(len(rows)), lens), np.concatenate([*rows["feats"], np.zeros(0, np.int64)]).astype(np.int64), grade, len(chosen))
    return {"table": shared, "w": w, "theta": theta}


def _exceedance(batch: pa.RecordBatch, w, theta, table) -> Iterator[tuple[int, int, np.ndarray]]:
    """P(grade > k) of runs of rows."""
    for i, j, data, offsets in byte_slices(batch):
        if table is None:
            yield i, j, np.zeros((j - i, GRADES - 1))
            continue
        r, f = feature_hits(data, offsets, table.value)
        r, f = _distinct(r, f)
        yield i, j, 1 / (1 + np.exp(-np.clip(np.bincount(r, w[f], j - i)[:, None] - theta, -35, 35)))


def clean_rows(docs: DataFrame, model: dict, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` below the cutoff, with all their columns."""
    w, theta, table = model["w"], model["theta"], model["table"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [up.sum(1) < cutoff for _, _, up in _exceedance(batch, w, theta, table)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(keep, docs.schema)


def score(docs: DataFrame, model: dict, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, rejected) per row of ``docs``."""
    w, theta, table = model["w"], model["theta"], model["table"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, up in _exceedance(batch, w, theta, table):
                severity = up.sum(1)
                full = np.concatenate([np.ones((j - i, 1)), up, np.zeros((j - i, 1))], 1)
                grade = (full[:, :-1] - full[:, 1:]).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.round(severity, 9)), pa.array(np.round(up[:, 0], 9)), pa.array(grade.astype(np.int32)), pa.array(severity >= cutoff)], ["doc_id", "severity", "p_toxic", "grade", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rate, "doc_id long, severity double, p_toxic double, grade int, rejected boolean")


def toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Fit on ``labels`` (doc_id, toxic) and score every row of ``docs``; see the module's text."""
    return score(docs, fit(docs, labels), cutoff)
