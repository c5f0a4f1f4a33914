"""The flagship question, "What tools does this actor use?", answered for a batch of questions by the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import extract, graph, retrieve
from .derived import Tables
from .notes import asked, entity_index


def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, note_id, score): notes, entities, edges and two-hop retrieval, the best ten per question."""
    t = Tables(spark, sf_dir)
    postings = extract.resolve_alias(entity_index(t)).select("entity_type", F.col("canonical").alias("entity_value"), "note_id")
    edges = postings.select(F.concat_ws(":", "entity_type", "entity_value").alias("from_id"), F.concat(F.lit("note:"), "note_id").alias("to_id"))
    starts = asked(t).select("query_id", F.concat_ws(":", "entity_type", "entity_value").alias("node"))
    found = graph.graph_retrieve(edges, starts, 1).select("query_id", F.col("note").alias("note_id"), "score")
    return retrieve._top(found, 10).select("query_id", "rank", "note_id", "score")
