"""The entity index: postings (entity_type, entity_value, note_id) and look-ups on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .extract import extract_all_long
from .fusion import best_postings, top_of_entities


def build_entity_index(entities: DataFrame) -> DataFrame:
    return entities.select("entity_type", "entity_value", "note_id").distinct()


def rebuild_indexes(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of all ``notes`` anew, and its statistics: (entity_type, entities, postings, notes_indexed)."""
    index = build_entity_index(extract_all_long(notes))
    stats = index.groupBy("entity_type").agg(F.count_distinct("entity_value").alias("entities"), F.count("*").alias("postings"))
    return index, stats.crossJoin(notes.agg(F.count("*").alias("notes_indexed")))  # one row


def index_remove_notes(index: DataFrame, notes: DataFrame) -> DataFrame:
    return index.join(notes.select("note_id").distinct(), "note_id", "left_anti").select("entity_type", "entity_value", "note_id")


def recall_entity(index: DataFrame, wanted: DataFrame, notes: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, note_id): the newest k notes over all entities (query_id, entity_type, entity_value) of a query; name
    one entity per query for the newest k of each. Each entity's newest k are found once, however many queries name it."""
    wanted = wanted.withColumn("entity_value", F.lower("entity_value"))
    postings = index.select("entity_type", "entity_value", "note_id").distinct().join(notes.select("note_id", F.col("created_at").alias("score")), "note_id")
    return top_of_entities(wanted, postings, k).select("query_id", "rank", "note_id")


def recall_typed(index: DataFrame, wanted: DataFrame, notes: DataFrame, kind: str, k: int) -> DataFrame:
    """``recall_entity`` for (query_id, entity_value) of one type."""
    return recall_entity(index, wanted.withColumn("entity_type", F.lit(kind)), notes, k)


def recall_actor(index: DataFrame, wanted: DataFrame, notes: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, note_id) for (query_id, entity_value): actors first, then threat actors, then intrusion sets.

    Each entity's newest k are found once: a note that isn't among them has k before it in any list that ranks it as high.
    """
    wanted = wanted.withColumn("entity_value", F.lower("entity_value")).distinct()
    order = F.when(F.col("entity_type") == "actor", 0).when(F.col("entity_type") == "threat_actor", 1).when(F.col("entity_type") == "intrusion_set", 2)
    hits = index.where(order.isNotNull()).join(wanted.select("entity_value").distinct(), "entity_value", "left_semi").select("entity_type", "entity_value", "note_id").distinct()
    best = best_postings(hits.join(notes.select("note_id", "created_at"), "note_id"), k, "created_at")
    best = best.withColumn("priority", order).join(wanted, "entity_value").groupBy("query_id", "note_id", "created_at").agg(F.min("priority").alias("priority"))
    w = Window.partitionBy("query_id").orderBy("priority", F.desc("created_at"), "note_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "note_id")


def search_entities_prefix(index: DataFrame, prefixes: DataFrame, limit: int = 10, letters: int = 3) -> DataFrame:
    """(prefix, entity_type, entity_value, n): per type the first ``limit`` values that begin with a prefix.

    Notes of all values are counted in one pass over the index. Values and prefixes meet by their first ``letters`` characters,
    or by all of a shorter prefix; each list of values is cut to ``limit`` in every task before it is shuffled.
    """
    asked = prefixes.select("prefix").where("prefix IS NOT NULL").distinct().withColumn("p", F.lower("prefix"))
    asked = asked.withColumn("size", F.least(F.length("p"), F.lit(letters))).withColumn("head", F.substring("p", 1, letters))
    sizes = F.sequence(F.lit(0), F.lit(letters))
    values = index.groupBy("entity_type", "entity_value").agg(F.countDistinct("note_id").alias("n")).select("*", F.explode(sizes).alias("size")).withColumn("head", F.expr("substring(entity_value, 1, size)"))
    values = values.join(F.broadcast(asked.select("size").distinct()), "size")  # a few numbers
    found = values.join(asked, ["size", "head"]).where(F.col("entity_value").startswith(F.col("p")))
    w = Window.partitionBy("prefix", "entity_type").orderBy("entity_value")
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).select("prefix", "entity_type", "entity_value", "n")


def entity_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("entity_type").agg(F.countDistinct("entity_value").alias("unique_entities"), F.count("*").alias("mappings"))


def entity_listing(index: DataFrame, kind: str | None = None, contains: str | None = None, offset: int = 0, limit: int = 50, tier: str | None = None, notes: DataFrame | None = None) -> DataFrame:
    """One page of (entity_type, entity_value, note_count, total), most notes first; with ``tier`` only over notes of it (of ``notes``)."""
    index = index if tier is None else index.join(notes.where(F.col("tier") == tier).select("note_id"), "note_id", "left_semi")
    rows = index.where(F.col("entity_type") == kind) if kind else index
    rows = rows.where(F.col("entity_value").contains(contains.lower())) if contains else rows
    counts = rows.groupBy("entity_type", "entity_value").agg(F.countDistinct("note_id").alias("note_count"))
    total = counts.agg(F.count("*").alias("total"))
    page = counts.orderBy(F.desc("note_count"), "entity_type", "entity_value").limit(offset + limit)
    w = Window.orderBy(F.desc("note_count"), "entity_type", "entity_value")
    return page.withColumn("k", F.row_number().over(w)).where(F.col("k") > offset).drop("k").crossJoin(F.broadcast(total))  # one row


def storage_stats(notes: DataFrame, index: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n): sizes of the four tables."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in (("notes", notes), ("entities", index.select("entity_type", "entity_value").distinct()), ("nodes", nodes), ("edges", edges))]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out
