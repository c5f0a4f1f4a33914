"""Retrieval for batches of queries: exact vector top-k, boosts, fusion, intents, augmentation and the whole recall."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import INTENT_KEYWORDS, POLICIES
from ..functions.lineage import cut
from . import extract, graph, index as postings
from .notes import expire_filter

BLOCK = 2048
DIM = 64


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles; 0 where a norm is 0."""
    da, db = (F.transform(v, lambda x: x.cast("double")) for v in (a, b))
    dot = F.aggregate(F.zip_with(da, db, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm(da) == 0) | (norm(db) == 0), F.lit(0.0)).otherwise(dot / (norm(da) * norm(db)))


def _blocks(rows: DataFrame, key: str, vector: str, group: str | None = None) -> DataFrame:
    """(ids, matrix, grp): rows in blocks of at most BLOCK vectors of equal length, as little-endian doubles."""
    label = F.col(group).cast("string") if group else F.lit("")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list] = {}
            for i, v, g in zip(*(c.to_pylist() for c in batch.columns)):
                if v and None not in v:
                    held.setdefault((len(v), g), []).append((i, v))
            for (_, g), pairs in held.items():
                for k in range(0, len(pairs), BLOCK):
                    part = pairs[k : k + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array([[i for i, _ in part]], pa.list_(pa.string())), pa.array([np.array([v for _, v in part], "<f8").tobytes()], pa.binary()), pa.array([g], pa.string())], ["ids", "matrix", "grp"])

    return rows.select(F.col(key).cast("string"), vector, label).mapInArrow(pack, "ids array<string>, matrix binary, grp string")


def cosine_pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, note_id, score): the cosine of every query with every vector; both sides (id, vector).

    Blocks of queries meet blocks of vectors; 0 where a norm is 0, and no row where the lengths differ or a value is null.
    """
    (qid, qvec), (vid, vvec) = queries.columns[:2], vectors.columns[:2]
    q = _blocks(queries, qid, qvec).select(F.col("ids").alias("qids"), F.col("matrix").alias("q"))
    pairs = q.crossJoin(_blocks(vectors, vid, vvec).select("ids", "matrix"))  # rows are blocks

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qids, qm, ids, m in zip(*batch.columns):
                a = np.frombuffer(qm.as_buffer(), "<f8").reshape(len(qids), -1)
                b = np.frombuffer(m.as_buffer(), "<f8").reshape(len(ids), -1)
                if a.shape[1] != b.shape[1]:
                    continue
                a, b = (x / np.where(n := np.linalg.norm(x, axis=1)[:, None], n, 1) for x in (a, b))
                for k, who in enumerate(qids.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([who] * len(ids), pa.string()), ids.values, pa.array(b @ a[k])], ["query_id", "note_id", "score"])

    found = pairs.mapInArrow(score, "query_id string, note_id string, score double")
    kinds = dict(queries.dtypes)[qid], dict(vectors.dtypes)[vid]
    return found.select(F.col("query_id").cast(kinds[0]).alias("query_id"), F.col("note_id").cast(kinds[1]).alias("note_id"), "score")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, threshold: float | None = 0.15, metric: str = "cosine", per: str | None = None, fetch: int | None = None) -> DataFrame:
    """(query_id, rank, note_id, score) of the k best vectors for each query; both sides (id, vector).

    Blocks of queries meet blocks of vectors, each pair a matrix product that keeps its own best ``fetch`` per query
    (and per value of ``per``), so no pair of single rows is ever a row. Scores are cosine, or 1 - distance for "l2";
    ties go to the smaller id.
    """
    fetch = fetch or k
    (qid, qvec), (vid, vvec) = queries.columns[:2], vectors.columns[:2]
    q = _blocks(queries, qid, qvec).select(F.col("ids").alias("qids"), F.col("matrix").alias("q"))
    pairs = q.crossJoin(_blocks(vectors, vid, vvec, per))  # rows are blocks

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qids, qm, ids, m, g in zip(*batch.columns):
                a = np.frombuffer(qm.as_buffer(), "<f8").reshape(len(qids), -1)
                b = np.frombuffer(m.as_buffer(), "<f8").reshape(len(ids), -1)
                if a.shape[1] != b.shape[1]:
                    continue
                if metric == "cosine":
                    na, nb = (np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
                    s = (a / np.where(na, na, 1)) @ (b / np.where(nb, nb, 1)).T
                else:
                    # by differences, 32 queries at a time: the expanded square loses digits for close vectors
                    s = 1 - np.concatenate([np.sqrt(((a[k : k + 32, None, :] - b) ** 2).sum(2)) for k in range(0, len(a), 32)])
                s = np.round(s, 9)
                names = np.array(ids.as_py(), object)
                order = np.argsort(names, kind="stable")
                best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :fetch]]
                top = np.take_along_axis(s, best, 1).ravel()
                keep = np.ones(len(top), bool) if threshold is None else top >= threshold
                who = np.repeat(np.array(qids.as_py(), object), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(who[keep], pa.string()), pa.array(names[best.ravel()[keep]], pa.string()), pa.array(top[keep]), pa.array([g.as_py()] * int(keep.sum()), pa.string())], ["query_id", "note_id", "score", "grp"])

    found = pairs.mapInArrow(score, "query_id string, note_id string, score double, grp string")
    order = [F.desc("score"), F.col("note_id")]
    if per:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "grp").orderBy(*order))).where(F.col("r") <= fetch)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "note_id", "score")


def vector_topk_l2(queries: DataFrame, vectors: DataFrame, k: int = 10, per: str = "domain") -> DataFrame:
    """The best 2k per domain by distance, merged to k; scores are 1 - distance, without a threshold."""
    return vector_topk(queries, vectors, k, None, "l2", per, 2 * k)


#: Vectors and values that an inverted file is fitted on at most, most lists, sign bits of a sketch, and sampled queries that
#: set probes and bits.
SAMPLE, VALUES, LISTS, BITS, TRIED = 20_000, 4_000_000, 4096, 512, 300


class InvertedFile:
    """Coarse centres, random hyperplanes, and how much of them a search needs for a wanted recall; fitted on a sample.

    A vector lies in the list of its nearest centre and has a sketch of sign bits. A query visits the lists of its ``probes``
    nearest centres and compares the vectors there whose sketch differs in at most ``differ`` bits. Both are set on sampled
    queries against the rest of the sample, whose neighbours lie farther than those among all vectors.
    """

    def __init__(self, sample: np.ndarray, rows: int, k: int, recall: float):
        rng = np.random.default_rng(11)
        unit = _unit(sample)
        self.planes = rng.standard_normal((unit.shape[1], BITS))
        lists = int(np.clip(4 * math.sqrt(rows), 1, min(LISTS, max(1, len(unit) // 4))))
        self.centres = unit[rng.permutation(len(unit))[:lists]].copy()
        for _ in range(6):
            of = (unit @ self.centres.T).argmax(1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, of, unit)
            held = np.abs(sums).sum(1) > 0
            self.centres[held] = sums[held]
            self.centres = _unit(self.centres)
        tried = unit[:TRIED]
        score = tried @ unit.T
        score[np.arange(len(tried)), np.arange(len(tried))] = -2
        near = np.argsort(-score, axis=1)[:, : min(k, len(unit) - 1)]
        order = np.argsort(-(tried @ self.centres.T), axis=1)
        place = np.argsort(order, axis=1)
        of = (unit @ self.centres.T).argmax(1)
        each = (1 + recall) / 2  # of the two steps
        self.probes = int(np.quantile(np.take_along_axis(place, of[near], 1), each, method="higher")) + 1 if near.size else lists
        codes = self.sketch(unit)
        self.differ = int(np.quantile(np.bitwise_count(codes[: len(tried), None] ^ codes[near]).sum(2), each, method="higher")) if near.size else BITS

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.planes > 0, axis=1).view(np.uint64)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1)[:, None]
    return x / np.where(n, n, 1)


def vector_topk_lsh(queries: DataFrame, vectors: DataFrame, k: int = 10, recall: float = 0.92, report: bool = False) -> DataFrame:
    """(query_id, rank, note_id, score): approximate top-k by cosine from an inverted file with sign sketches; both sides (id, vector).

    ``InvertedFile`` is fitted on at most SAMPLE vectors (VALUES values) for the wanted ``recall``. Blocks of queries meet the blocks of each
    list; sketches of visited lists are compared by bits, and only vectors that pass by cosine. A query with fewer than k
    hits takes the exact pass of ``vector_topk``. Vectors of a length other than the sample's most common one are left out,
    null ones too. ``report`` adds ``compared``, the number of vectors whose cosine a query took.
    """
    (qid, qvec), (vid, vvec) = queries.columns[:2], vectors.columns[:2]
    good = vectors.where(F.col(vvec).isNotNull() & ~F.exists(vvec, lambda x: x.isNull()) & (F.size(vvec) > 0))
    count, longest = good.agg(F.count("*"), F.max(F.size(vvec))).first()
    sampled = good.orderBy(F.xxhash64(vid), vid).limit(min(SAMPLE, VALUES // (longest or 1))).select(vvec).toPandas()[vvec].tolist()
    if not len(sampled):
        return vector_topk(queries, vectors, k, None).withColumn("compared", F.lit(0).cast("long")).drop(*([] if report else ["compared"]))
    lengths = Counter(map(len, sampled))
    dim = min(lengths, key=lambda d: (-lengths[d], d))
    fitted = queries.sparkSession.sparkContext.broadcast(InvertedFile(np.array([v for v in sampled if len(v) == dim], np.float64), count, k, recall))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            of = (_unit(flat) @ fitted.value.centres.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of.astype(str).tolist(), pa.string())], ["id", "vector", "list"])

    sized = good.where(F.size(vvec) == dim).select(F.col(vid).cast("string").alias("id"), F.col(vvec).cast("array<double>").alias("vector"))
    listed = sized.mapInArrow(assign, "id string, vector array<double>, list string")
    index = _blocks(listed.repartition("list").sortWithinPartitions("list"), "id", "vector", "list")
    asked = _blocks(queries.where(F.size(qvec) == dim), qid, qvec).select(F.col("ids").alias("qids"), F.col("matrix").alias("q"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, held, a = fitted.value, None, None
        for batch in batches:
            for qids, qm, ids, m, of in zip(*batch.columns):
                raw = qm.as_buffer().to_pybytes()
                if raw != held:  # the same queries meet many lists
                    held, a, who = raw, _unit(np.frombuffer(raw, "<f8").reshape(len(qids), -1)), np.array(qids.as_py(), object)
                    near = np.argsort(np.argsort(-(a @ f.centres.T), axis=1), axis=1) < f.probes
                    codes = f.sketch(a)
                mine = np.flatnonzero(near[:, int(of.as_py())])
                names, b = np.array(ids.as_py(), object), _unit(np.frombuffer(m.as_buffer(), "<f8").reshape(len(ids), -1))
                own = f.sketch(b)
                i, j = np.nonzero(np.bitwise_count(codes[mine, None] ^ own[None]).sum(2) <= f.differ)
                i = mine[i]
                score = np.round(np.einsum("ij,ij->i", a[i], b[j]), 9)
                order = np.lexsort((names[j], -score, i)) if len(i) else i
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                top = np.arange(len(i)) - first < k
                some, n = np.unique(i, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(who[i[top]], who[some]), pa.string()), pa.array(names[j[top]].tolist() + [None] * len(some), pa.string()), pa.array(np.append(score[top], n.astype(float)))], ["query_id", "note_id", "score"])

    found = cut(asked.crossJoin(index).mapInArrow(search, "query_id string, note_id string, score double"))
    best = cut(_top(found.where("note_id IS NOT NULL"), k).select("query_id", "rank", "note_id", "score"))
    full = best.where(F.col("rank") == k).select("query_id")
    short = queries.join(full, F.col(qid).cast("string") == F.col("query_id"), "left_anti")
    out = best.join(full, "query_id", "left_semi").union(vector_topk(short, vectors, k, None))
    if not report:
        return out
    compared = found.where("note_id IS NULL").groupBy("query_id").agg(F.sum("score").cast("long").alias("n"))
    return out.join(compared, "query_id", "left").join(full.withColumn("done", F.lit(True)), "query_id", "left").select("query_id", "rank", "note_id", "score", F.when(F.col("done"), F.col("n")).otherwise(F.lit(count)).alias("compared"))


def embed_batch(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, vector): a deterministic vector of hashed lower-case words, the stand-in where no model is given."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, dim), np.float32)
            for k, t in enumerate(batch.column(1).to_pylist()):
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.strip(".,;:!?").encode())
                    out[k, h % dim] += 1 if h >> 16 & 1 else -1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float32()))], batch.schema.names[:1] + ["vector"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInArrow(embed, f"`{key}` {kind}, vector array<float>")


def repair_embeddings(rows: DataFrame, key: str, text: str, vector: str, valid: Column) -> DataFrame:
    """``rows`` (key, text, vector) with invalid vectors replaced by ``embed_batch``."""
    made = embed_batch(rows.where(~valid), key, text).withColumnRenamed("vector", "made")
    return rows.join(made, key, "left").select(key, F.coalesce("made", vector).alias(vector), F.col("made").isNotNull().alias("repaired"))


def entity_boost(scored: DataFrame, query_entities: DataFrame, note_entities: DataFrame, notes: DataFrame, boost: float = 2.5, exact: float = 1.0) -> DataFrame:
    """(query_id, note_id, score): scores times boost to the number of shared entities, times ``exact`` for each query
    entity that the note's text contains."""
    q = query_entities.select("query_id", "entity_value").distinct()
    shared = scored.select("query_id", "note_id").join(q, "query_id").join(note_entities.select("note_id", "entity_value").distinct(), ["note_id", "entity_value"]).groupBy("query_id", "note_id").agg(F.count("*").alias("n"))
    out = scored.join(shared, ["query_id", "note_id"], "left").withColumn("score", F.col("score") * F.pow(F.lit(boost), F.coalesce("n", F.lit(0)))).drop("n")
    if exact != 1.0:
        hits = scored.select("query_id", "note_id").join(q, "query_id").join(notes.select("note_id", F.lower("content_raw").alias("t")), "note_id").where(F.col("t").contains(F.lower("entity_value"))).groupBy("query_id", "note_id").agg(F.count("*").alias("h"))
        out = out.join(hits, ["query_id", "note_id"], "left").withColumn("score", F.col("score") * F.pow(F.lit(exact), F.coalesce("h", F.lit(0)))).drop("h")
    return out.select("query_id", "note_id", "score")


def expand_links(scored: DataFrame, links: DataFrame, limit: int = 20) -> DataFrame:
    """Adds notes linked (note_id, related) from scored ones at half the best parent's score, up to ``limit`` per query.

    Scored notes come first, so only queries with fewer than ``limit`` of them follow links.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "note_id")
    kept = cut(scored.withColumn("k", F.row_number().over(best)).where(F.col("k") <= limit).select("query_id", "note_id", "score"))
    few = kept.join(kept.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") < limit), "query_id", "left_semi")
    new = few.join(links, "note_id").select("query_id", F.col("related").alias("note_id"), (F.col("score") / 2).alias("score")).groupBy("query_id", "note_id").agg(F.max("score").alias("score"))
    new = new.join(few.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti")
    both = kept.select("query_id", "note_id", "score", F.lit(0).alias("hop")).union(new.select("query_id", "note_id", "score", F.lit(1)))
    w = Window.partitionBy("query_id").orderBy("hop", F.desc("score"), "note_id")
    return both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).select("query_id", "note_id", "score")


def minmax_normalize(scored: DataFrame, by: str = "query_id") -> DataFrame:
    """Scores of each query spread over 0 to 1; 0.5 where all are equal."""
    w = Window.partitionBy(by)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", F.when(hi - lo < 1e-9, 0.5).otherwise((F.col("score") - lo) / (hi - lo)))


def _top(rows: DataFrame, k: int, *order) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *order, "note_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blend_weighted(vector: DataFrame, graph_: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, note_id, score): normalised scores times the query's weights (query_id, vector, graph), summed."""
    return _fuse(minmax_normalize(vector), minmax_normalize(graph_), weights, k)


def _fuse(vector: DataFrame, graph_: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``blend_weighted`` of scores that are normalised already."""
    v = vector.select("query_id", "note_id", F.col("score").alias("vs"))
    g = graph_.select("query_id", "note_id", F.col("score").alias("gs"))
    w = weights.select("query_id", F.col("vector").alias("wv"), F.col("graph").alias("wg"))
    both = v.join(g, ["query_id", "note_id"], "full").join(w, "query_id")
    score = F.coalesce(F.col("vs") * F.col("wv"), F.lit(0.0)) + F.coalesce(F.col("gs") * F.col("wg"), F.lit(0.0))
    return _top(both.withColumn("score", F.round(score, 9)), k).select("query_id", "rank", "note_id", "score")


def blend_rrf(vector: DataFrame, graph_: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """(query_id, rank, note_id, score): sums of 1 / (c + rank)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "note_id")
    part = lambda d: d.withColumn("r", F.row_number().over(w)).select("query_id", "note_id", (1 / (c + F.col("r"))).alias("s"))
    both = part(vector).union(part(graph_)).groupBy("query_id", "note_id").agg(F.round(F.sum("s"), 9).alias("score"))
    return _top(both, k).select("query_id", "rank", "note_id", "score")


def classify_intent(text: Column) -> Column:
    """struct(intent, confidence, method) by counting keywords; ties go to the earlier intent."""
    low = F.lower(text)
    names = list(INTENT_KEYWORDS)
    scores = F.array(*[F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))) for words in INTENT_KEYWORDS.values()])
    best = F.array_max(scores)
    first = F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, best).cast("int"))
    alone = (best == 1) & (F.size(F.filter(scores, lambda s: s > 0)) == 1)
    intent = F.when((best >= 2) | alone, first).otherwise("exploratory")
    confidence = F.when(best >= 2, F.least(F.lit(1.0), best / 4)).when(alone, 0.6).otherwise(0.3)
    method = F.when(best >= 2, "keyword").when(alone, "keyword_unambiguous").otherwise("default")
    return F.struct(intent.alias("intent"), confidence.alias("confidence"), method.alias("method"))


def traversal_policy(intents: DataFrame) -> DataFrame:
    """Adds the weights of each row's ``intent``; unknown names take the exploratory ones."""
    table = intents.sparkSession.createDataFrame(POLICIES, "intent string, vector double, entity_index double, graph double, temporal double, top_k int")
    known = F.when(F.col("intent").isin(*[p[0] for p in POLICIES]), F.col("intent")).otherwise("exploratory")
    return intents.withColumn("policy", known).join(F.broadcast(table.withColumnRenamed("intent", "policy")), "policy").drop("policy")  # six rows


def temporal_boost(scored: DataFrame, queries: DataFrame, notes: DataFrame) -> DataFrame:
    """(query_id, rank, note_id, dated): for temporal questions that hold a year, notes that hold it come first."""
    asked = queries.select("query_id", F.when(classify_intent(F.col("text"))["intent"] == "temporal", F.nullif(F.regexp_extract("text", r"\b(?:19|20)\d{2}\b", 0), F.lit(""))).alias("year"))
    rows = scored.join(asked, "query_id", "left").join(notes.select("note_id", "content_raw", "created_at"), "note_id")
    dated = F.coalesce(F.col("content_raw").contains(F.col("year")) | (F.year("created_at").cast("string") == F.col("year")), F.lit(False))
    rows = rows.withColumn("dated", dated)
    w = Window.partitionBy("query_id").orderBy(F.desc("dated"), F.desc("score"), "note_id")
    return rows.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "note_id", "dated")


def entity_augment(ranked: DataFrame, hits: DataFrame, most: int | None = 3) -> DataFrame:
    """(query_id, rank, note_id): up to ``most`` (None: all) entity hits that the ranked list lacks, after its end."""
    new = hits.join(ranked.select("query_id", "note_id"), ["query_id", "note_id"], "left_anti")
    new = new.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "note_id")))
    new = new if most is None else new.where(F.col("k") <= most)
    ends = ranked.groupBy("query_id").agg(F.max("rank").alias("last"))
    return ranked.select("query_id", "rank", "note_id").union(new.join(ends, "query_id", "left").select("query_id", (F.coalesce("last", F.lit(0)) + F.col("k")).alias("rank"), "note_id"))


def causal_augment(ranked: DataFrame, chain: DataFrame) -> DataFrame:
    """(query_id, note_id) of ``ranked`` and of the note ends of causal chains (query_id, from_id, to_id)."""
    ends = chain.select("query_id", F.col("from_id").alias("note_id")).union(chain.select("query_id", "to_id")).where(F.col("note_id").startswith("note:"))
    return ranked.select("query_id", "note_id").union(ends).distinct()


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` has."""
    wa, wb = (F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")) for x in (a, b))
    return F.when(F.size(wa) == 0, 0.0).otherwise(F.size(F.array_intersect(wa, wb)) / F.size(wa))


def rerank(ranked: DataFrame, queries: DataFrame, notes: DataFrame, scorer=token_overlap) -> DataFrame:
    """(query_id, rank, note_id, score): by ``scorer`` of the query and the first 512 characters, then the rank before."""
    rows = ranked.withColumnRenamed("rank", "before").join(queries.select("query_id", "text"), "query_id").join(notes.select("note_id", "content_raw"), "note_id")
    rows = rows.withColumn("score", F.round(scorer(F.col("text"), F.substring("content_raw", 1, 512)), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "before", "note_id")
    return rows.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "note_id", "score")


def recall(queries: DataFrame, notes: DataFrame, index: DataFrame, k: int = 10, as_of: str | None = None, superseded: DataFrame | None = None, edges: DataFrame | None = None, links: DataFrame | None = None, scorer=token_overlap) -> DataFrame:
    """(query_id, rank, note_id): the whole retrieval, in the order of its steps.

    1. Vector top-k with entity boost and, with ``links`` (note_id, related), linked notes; for temporal questions dated
       notes come first.
    2. Graph walk of two hops from the question's entities over ``edges`` (from_id, to_id, relationship, edge_type; by
       default the postings), fused with the vector scores by the intent's weights. A question with fewer fused notes than
       vector ones takes the latter in their order.
    3. Causal questions add the notes at the ends of causal edges within three hops, both ways; then each entity adds its
       newest three notes.
    4. Reranking by ``scorer`` (None: none); notes of ``superseded`` (note_id) and those expired at ``as_of`` go; k stay.

    ``queries`` (query_id, text); ``notes`` with content_raw, created_at, persistence; ``index`` postings. Aliases are
    resolved on both sides. Questions that find nothing have no row.
    """
    intents = cut(traversal_policy(queries.select("query_id", classify_intent(F.col("text"))["intent"].alias("intent"))))
    named = lambda d, key: extract.resolve_alias(d).select(key, "entity_type", F.col("canonical").alias("entity_value")).distinct()
    known = cut(named(index, "note_id"))
    asked = cut(named(extract.extract_all_long(queries, "text", "query_id"), "query_id"))
    node = F.concat_ws(":", "entity_type", "entity_value")

    qv = embed_batch(queries.withColumn("query_id", F.col("query_id").cast("string")), "query_id", "text")
    found = vector_topk(qv, embed_batch(notes, "note_id", "content_raw"), k).withColumnRenamed("query_id", "q")
    ids = queries.select(F.col("query_id").cast("string").alias("q"), "query_id")
    vector = entity_boost(found.join(ids, "q").select("query_id", "note_id", "score"), asked, known, notes)
    vector = cut(expand_links(vector, links) if links is not None else vector)

    if edges is None:
        edges = known.select(node.alias("from_id"), F.concat(F.lit("note:"), "note_id").alias("to_id"), F.lit("MENTIONED_IN").alias("relationship"), F.lit("heuristic").alias("edge_type"))
    starts = asked.select("query_id", node.alias("node"))
    walked = cut(graph.graph_retrieve(edges, starts, 2).select("query_id", F.substring("note", 6, 1000).alias("note_id"), "score"))
    # only a query's k best by the graph or its vector hits can be among the fused k; bounds come from all walked
    near = _top(walked, k).select("query_id", "note_id", "score").union(walked.join(vector.select("query_id", "note_id"), ["query_id", "note_id"], "left_semi").select("query_id", "note_id", "score")).distinct()
    near = near.join(walked.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi")), "query_id")
    near = near.withColumn("score", F.when(F.col("hi") - F.col("lo") < 1e-9, 0.5).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    fused = cut(_fuse(minmax_normalize(vector), near, intents, k))
    number = lambda d, name: d.groupBy("query_id").agg(F.count("*").alias(name))
    short = number(vector, "nv").join(number(fused, "nf"), "query_id", "left").where("coalesce(nf, 0) < nv").select("query_id")
    ordered = temporal_boost(vector, queries, notes).where(F.col("rank") <= k).select("query_id", "rank", "note_id")
    ranked = cut(fused.join(short, "query_id", "left_anti").select("query_id", "rank", "note_id").union(ordered.join(short, "query_id", "left_semi")))

    why = starts.join(intents.where("intent = 'causal'").select("query_id"), "query_id", "left_semi")
    edges = cut(edges.where("edge_type = 'causal'"))  # read at each depth, both ways
    chains = [graph.causal_chain(edges, why.select("node").distinct(), forward, 3) for forward in (True, False)]
    chain = chains[0].union(chains[1]).join(why, F.col("start") == F.col("node")).select("query_id", "from_id", "to_id")
    caused = causal_augment(ranked, chain).select("query_id", F.regexp_replace("note_id", "^note:", "").alias("note_id")).distinct()
    ranked = cut(entity_augment(ranked, caused.join(notes.select("note_id"), "note_id", "left_semi").withColumn("rank", F.lit(1)), None))
    entity = F.struct("entity_type", "entity_value")
    newest = postings.recall_entity(known, asked.select(entity.alias("query_id"), "entity_type", "entity_value").distinct(), notes, 3)
    hits = asked.select("query_id", entity.alias("e")).join(newest.withColumnRenamed("query_id", "e"), "e").groupBy("query_id", "note_id").agg(F.min("rank").alias("rank"))
    ranked = entity_augment(ranked, hits, None)

    ranked = rerank(ranked, queries, notes, scorer).select("query_id", "rank", "note_id") if scorer else ranked
    live = (expire_filter(notes, as_of) if as_of else notes).select("note_id")
    live = live if superseded is None else live.join(superseded.select("note_id").distinct(), "note_id", "left_anti")
    kept = ranked.join(live, "note_id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "note_id"))).where(F.col("rank") <= k).select("query_id", "rank", "note_id")


def format_context(ranked: DataFrame, notes: DataFrame, budget: int = 500) -> DataFrame:
    """(query_id, context): a numbered list of notes, 300 characters each, cut at four characters per token."""
    rows = ranked.join(notes.select("note_id", F.substring("content_raw", 1, 300).alias("t")), "note_id")
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("t")).alias("line"))))
    return rows.groupBy("query_id").agg(F.substring(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 1, 4 * budget).alias("context"))


# fixed values: words of a question that say nothing about its subject
QUESTION_STOPWORDS = ("what", "where", "when", "who", "how", "did", "does", "is", "the", "a", "an", "from", "to", "for", "of", "likely", "would", "still", "want")


def keyword_inject(queries: DataFrame, notes: DataFrame, found: DataFrame, k: int = 3, rare: int = 1000) -> DataFrame:
    """(query_id, rank, note_id, overlap): notes outside ``found`` that share most question words, the best k.

    Words of at most ``rare`` notes lead to notes, for which the common words are then counted. Notes with common words only
    are ranked once for each set of common words that questions have: of those, a question needs its k best and as many more as
    ``found`` can hold of them.
    """
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), r"\s+")))
    q = queries.select("query_id", words(F.col("text")).alias("w")).where((F.col("w") != "") & ~F.col("w").isin(*QUESTION_STOPWORDS)).distinct()
    n = notes.select("note_id", words(F.col("content_raw")).alias("w")).distinct()
    n = cut(n.join(q.select("w").distinct(), "w", "left_semi"))
    q = cut(q.join(n.groupBy("w").agg((F.count("*") > rare).alias("common")), "w"))
    some = q.where("NOT common").join(n, "w").groupBy("query_id", "note_id").agg(F.count("*").alias("few"))
    more = some.select("query_id", "note_id").join(q.where("common").select("query_id", "w"), "query_id").join(n, ["note_id", "w"]).groupBy("query_id", "note_id").agg(F.count("*").alias("many"))
    led = some.join(more, ["query_id", "note_id"], "left").select("query_id", "note_id", (F.col("few") + F.coalesce("many", F.lit(0))).alias("overlap"))

    sets = q.where("common").groupBy("query_id").agg(F.sort_array(F.collect_list("w")).alias("words"))
    sets = cut(sets.withColumn("set", F.sha2(F.array_join("words", " "), 256)))
    reach = k + (found.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
    ranked = sets.dropDuplicates(["set"]).select("set", F.explode("words").alias("w")).join(n, "w").groupBy("set", "note_id").agg(F.count("*").alias("overlap"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("overlap"), "note_id"))).where(F.col("r") <= reach)
    hits = led.union(sets.select("query_id", "set").join(ranked, "set").select("query_id", "note_id", "overlap")).groupBy("query_id", "note_id").agg(F.max("overlap").alias("overlap"))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "note_id")
    hits = hits.join(found, ["query_id", "note_id"], "left_anti")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "note_id", "overlap")


def relevant_sentences(pairs: DataFrame, key: str, question: str, context: str, k: int = 5) -> DataFrame:
    """(key, rank, sentence): the k sentences over ten characters that share most words with the question."""
    parts = F.transform(F.split(F.replace(F.col(context), F.lit("\n"), F.lit(". ")), r"\."), lambda s: F.trim(s))
    rows = pairs.select(key, question, F.posexplode(F.filter(parts, lambda s: F.length(s) > 10)).alias("at", "sentence"))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    rows = rows.withColumn("overlap", F.size(F.array_intersect(words(F.col(question)), words(F.col("sentence"))))).where("overlap > 0")
    w = Window.partitionBy(key).orderBy(F.desc("overlap"), "at")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "sentence", "overlap")


def snippet(question: Column, context: Column, size: int = 300) -> Column:
    """The sentence of ``context`` that shares most words with the question, cut at ``size``."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    scored = F.transform(F.split(context, r"(?<=[.!?])\s+"), lambda s, i: F.struct(F.size(F.array_intersect(words(question), words(s))).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.substring(F.array_max(scored)["s"], 1, size)


def memory_search(queries: DataFrame, vectors: DataFrame, source: str | None = None, k: int = 10, session: str | None = None) -> DataFrame:
    """``vector_topk`` among the vectors of one source and one session, or all; ``vectors`` (id, vector, source, session_key)."""
    for column, wanted in (("source", source), ("session_key", session)):
        vectors = vectors if wanted is None else vectors.where(F.col(column) == wanted)
    return vector_topk(queries, vectors.select(*vectors.columns[:2]), k, None)


def parameter_sweep(scored: DataFrame, truth: DataFrame, thresholds: tuple[float, ...], boosts: tuple[float, ...]) -> DataFrame:
    """(threshold, boost, hits, returned, f): the grid of settings over scored pairs (query_id, note_id, score, shared).

    Both sides may have ``asks``, the number of equal queries that a row stands for. Pairs are counted by score, shared and hit
    before they meet the grid.
    """
    scored, truth = (d if "asks" in d.columns else d.withColumn("asks", F.lit(1)) for d in (scored, truth))
    wanted = truth.select("query_id", "note_id", F.lit(1).alias("hit"))
    counts = scored.join(wanted, ["query_id", "note_id"], "left").groupBy("score", "shared", F.coalesce("hit", F.lit(0)).alias("hit")).agg(F.sum("asks").alias("n"))
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(b).alias("boost")) for t in thresholds for b in boosts]))
    rows = counts.withColumn("g", grid).select("*", "g.threshold", "g.boost").where(F.col("score") * F.pow("boost", "shared") >= F.col("threshold"))
    total = truth.agg(F.coalesce(F.sum("asks"), F.lit(0)).alias("wanted"))
    out = rows.groupBy("threshold", "boost").agg(F.sum(F.col("hit") * F.col("n")).alias("hits"), F.sum("n").alias("returned")).crossJoin(F.broadcast(total))  # one row
    return out.select("threshold", "boost", "hits", "returned", F.round(2 * F.col("hits") / (F.col("returned") + F.col("wanted")), 6).alias("f"))
