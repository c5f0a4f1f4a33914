"""Top-k fusion over posting lists: what can't be among a question's k best is left out once per entity, not once per question.

A posting list has an entity's notes with the scores of the signals, which don't depend on the question. So what is best in a
list, or for a set of entities and weights, is found once, however many questions ask for it, and questions only take up the
answers. The results are those over all pairs of question and note.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.ordered import numbered

ENTITY = ["entity_type", "entity_value"]
#: Rows of a cell of ``give_out`` on either side, about, and pairs of a task.
SIDE, PAIRS = 1000, 10_000_000
_BAND = "entity_type string, entity_value string, note_id string, vs double, gs double"


def give_out(answers: DataFrame, askers: DataFrame, key: str) -> DataFrame:
    """``answers`` joined with ``askers`` by ``key``, where a key may have most of all pairs: the rows of a join, in even tasks.

    A key's pairs are cut into cells of about SIDE answers and SIDE askers, and cells are dealt over tasks of about PAIRS pairs. A
    row goes to as many cells as the other side is cut into, so a thousandth of the pairs is shuffled.
    """
    answers = cut(answers)
    sizes = cut(answers.groupBy(key).agg(F.count("*").alias("n")).join(askers.groupBy(key).agg(F.count("*").alias("m")), key))
    pairs = sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(3 * answers.sparkSession.sparkContext.defaultParallelism, -(-int(pairs) // PAIRS))
    cells = sizes.select(key, F.ceil(F.col("n") / SIDE).alias("n"), F.ceil(F.col("m") / SIDE).alias("m"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.col(own))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return rows.join(cells, key).select(*rows.columns, place.alias(f"_{own}"), every.alias(f"_{other}")).repartition(tasks, key, "_n", "_m")

    # by hash: the askers of a task's cells are held, answers stream past them
    return dealt(answers, "n", "m").join(dealt(askers, "m", "n").hint("shuffle_hash"), [key, "_n", "_m"]).drop("_n", "_m")


def best_postings(postings: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` best notes of each entity of ``postings`` (entity_type, entity_value, note_id, score): ties to the smaller id.

    Spark cuts each list to k in every task before it shuffles.
    """
    w = Window.partitionBy(*ENTITY).orderBy(F.desc(score), "note_id")
    return postings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def top_of_entities(asked: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, note_id, score): the ``k`` best notes over all entities of a question (query_id, entity_type, entity_value)."""
    best = best_postings(postings.join(asked.select(*ENTITY).distinct(), ENTITY, "left_semi"), k)
    rows = asked.join(best, ENTITY).select("query_id", "note_id", "score").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "note_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "note_id", "score")


def _band(vs: np.ndarray, gs: np.ndarray, k: int) -> np.ndarray:
    """Which of rows in the order of their ids are below fewer than ``k`` earlier ones in both scores; those kept suffice to tell."""
    kept_v, kept_g, out = np.zeros(0), np.zeros(0), []
    for lo in range(0, len(vs), 256):
        v, g = vs[lo : lo + 256], gs[lo : lo + 256]
        above = ((kept_v[None] >= v[:, None]) & (kept_g[None] >= g[:, None])).sum(1)
        above += np.tril((v[None] >= v[:, None]) & (g[None] >= g[:, None]), -1).sum(1)
        keep = above < k
        kept_v, kept_g = np.append(kept_v, v[keep]), np.append(kept_g, g[keep])
        out.append(keep)
    return np.concatenate(out) if out else np.zeros(0, bool)


def skyband(postings: DataFrame, k: int) -> DataFrame:
    """Rows of ``postings`` (entity_type, entity_value, note_id, vs, gs; null: no such score) that some weights of the two scores
    can bring among the ``k`` best of their entity, ties going to the smaller id.

    A note with k others of smaller id that are as good in both scores is never among them. Tasks leave out what their own rows
    outdo, then parts of each list, then lists: notes that one step outdoes are not needed to outdo others.
    """

    def outdone(t: pa.Table) -> pa.Table:
        t = t.sort_by([("entity_type", "ascending"), ("entity_value", "ascending"), ("note_id", "ascending")])
        vs, gs = (np.nan_to_num(t.column(c).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf) for c in ("vs", "gs"))
        names = [t.column(c).combine_chunks() for c in ENTITY]
        new = np.any([pc.not_equal(n[1:], n[:-1]).to_numpy(zero_copy_only=False) for n in names], axis=0) if t.num_rows else np.zeros(0, bool)
        edge = np.flatnonzero(np.concatenate([[True], new, [True]])) if t.num_rows else []
        keep = [np.ones(hi - lo, bool) if hi - lo <= k else _band(vs[lo:hi], gs[lo:hi], k) for lo, hi in zip(edge[:-1], edge[1:])]
        return t.filter(pa.array(np.concatenate(keep))) if keep else t

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from outdone(pa.Table.from_batches([batch])).to_batches()

    rows = postings.select(*ENTITY, "note_id", F.col("vs").cast("double").alias("vs"), F.col("gs").cast("double").alias("gs"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.mapInArrow(by_batch, _BAND).withColumn("part", F.pmod(F.xxhash64("note_id"), F.lit(parts)).cast("int"))
    some = some.groupBy(*ENTITY, "part").applyInArrow(lambda t: outdone(t.drop(["part"])), _BAND)
    return some.groupBy(*ENTITY).applyInArrow(outdone, _BAND)


def _spread(score: str, lo: str, hi: str):
    """``score`` from 0 to 1 between the bounds, 0.5 where they are equal, 0 where there is none."""
    width = F.col(hi) - F.col(lo)
    return F.when(F.col(score).isNull(), 0.0).when(width < 1e-9, 0.5).otherwise((F.col(score) - F.col(lo)) / width)


def _sets(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, list) and (list, entity_type, entity_value): each different set of entities of a question is one list."""
    sets = asked.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct(*ENTITY))).alias("entities"))
    sets = cut(sets.withColumn("list", F.sha2(F.to_json("entities"), 256)))
    return sets.select("query_id", "list"), sets.select("list", "entities").dropDuplicates(["list"]).select("list", F.explode("entities").alias("e")).select("list", "e.*")


def blend_weighted_postings(asked: DataFrame, postings: DataFrame, weights: DataFrame, k: int = 10, prune: bool = False) -> DataFrame:
    """(query_id, rank, note_id, score): ``retrieve.blend_weighted`` of all notes that share an entity with a question.

    ``asked`` (query_id, entity_type, entity_value); ``postings`` (entity_type, entity_value, note_id, vs, gs), a null score
    where a signal doesn't have the note; ``weights`` (query_id, vector, graph), not negative. Bounds of a question's scores
    are those of its lists.

    Questions of the same entities and weights have the same answer, so each such set is fused once. With ``prune``, where most
    questions have a set of their own, sets meet the ``skyband`` of their entities instead of all of the lists.
    """
    sets, lists = _sets(asked)
    rows = cut(postings.where("vs IS NOT NULL OR gs IS NOT NULL").join(lists.select(*ENTITY).distinct(), ENTITY, "left_semi"))
    ends = rows.groupBy(*ENTITY).agg(F.min("vs").alias("v0"), F.max("vs").alias("v1"), F.min("gs").alias("g0"), F.max("gs").alias("g1"))
    ends = lists.join(ends, ENTITY).groupBy("list").agg(F.min("v0").alias("v0"), F.max("v1").alias("v1"), F.min("g0").alias("g0"), F.max("g1").alias("g1"))
    some = lists.join(skyband(rows, k) if prune else rows, ENTITY).select("list", "note_id", "vs", "gs").distinct()
    weighted = cut(sets.join(weights.select("query_id", F.col("vector").alias("wv"), F.col("graph").alias("wg")), "query_id"))
    both = some.join(weighted.select("list", "wv", "wg").distinct(), "list").join(ends, "list")
    score = F.round(_spread("vs", "v0", "v1") * F.col("wv") + _spread("gs", "g0", "g1") * F.col("wg"), 9)
    w = Window.partitionBy("list", "wv", "wg").orderBy(F.desc("score"), "note_id")
    best = both.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("list", "wv", "wg", "rank", "note_id", "score")
    return weighted.join(best, ["list", "wv", "wg"]).select("query_id", "rank", "note_id", "score")


def blend_rrf_postings(asked: DataFrame, postings: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """(query_id, rank, note_id, score): ``retrieve.blend_rrf`` of all notes that share an entity with a question.

    Questions with the same entities have the same answer, so each set of entities is one list, ranked once for both signals
    over sorted range partitions; arguments as for ``blend_weighted_postings``.
    """
    sets, lists = _sets(asked)
    rows = cut(lists.join(postings, ENTITY).select("list", "note_id", "vs", "gs").distinct())

    def ranked(score: str) -> DataFrame:
        at = numbered(rows.where(F.col(score).isNotNull()).select("list", "note_id", (-F.col(score)).alias("less")), ["list", "less", "note_id"], 1 << 20)
        first = at.groupBy("list").agg(F.min("at").alias("first"))
        return at.join(first, "list").select("list", "note_id", (1 / (c + 1 + F.col("at") - F.col("first"))).alias("s"))

    both = ranked("vs").union(ranked("gs")).groupBy("list", "note_id").agg(F.round(F.sum("s"), 9).alias("score"))
    w = Window.partitionBy("list").orderBy(F.desc("score"), "note_id")
    best = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return sets.select("query_id", "list").join(best, "list").select("query_id", "rank", "note_id", "score")
