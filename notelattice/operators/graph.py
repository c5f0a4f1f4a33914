"""The knowledge graph: nodes and edges from entities, upserts, and multi-hop queries by frontier joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut
from ..functions.rules import EDGE_RULES
from .extract import infer_entity_type, resolve_alias

KEY = ("from_id", "to_id", "relationship", "note_id")


def upsert_nodes(rows: DataFrame, merge: bool = False) -> DataFrame:
    """One node per (entity_type, entity_value) from observations with ``properties`` and ``ts``.

    The latest non-empty properties replace earlier ones, or with ``merge`` later keys override earlier ones.
    """
    some = F.size("properties") > 0
    if merge:
        pairs = rows.select("entity_type", "entity_value", "ts", F.explode_outer("properties").alias("k", "v"))
        last = pairs.groupBy("entity_type", "entity_value", "k").agg(F.max_by("v", "ts").alias("v"), F.min("ts").alias("a"), F.max("ts").alias("b"))
        out = last.groupBy("entity_type", "entity_value").agg(F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["k"].isNotNull())).alias("properties"), F.min("a").alias("created_at"), F.max("b").alias("updated_at"))
    else:
        out = rows.groupBy("entity_type", "entity_value").agg(F.max_by("properties", F.when(some, F.col("ts"))).alias("properties"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    return out.withColumn("node_id", F.sha2(F.concat_ws(":", "entity_type", "entity_value"), 256))


def upsert_edges(rows: DataFrame) -> DataFrame:
    """One edge per (from, to, relationship, note): first and last time, the first type that isn't heuristic if any, and,
    where rows have ``properties``, the last that aren't empty."""
    specific = F.col("edge_type") != "heuristic"
    last = [F.max_by("properties", F.when(F.size("properties") > 0, F.col("created_at"))).alias("properties")] if "properties" in rows.columns else []
    return rows.groupBy(*KEY).agg(*last, F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("observations"), F.coalesce(F.min_by("edge_type", F.when(specific, F.col("created_at"))), F.lit("heuristic")).alias("edge_type"))


def promote_edge_type(rows: DataFrame) -> DataFrame:
    """Per (from, to, relationship) the first specific type by time, else heuristic."""
    first = F.min(F.when(F.col("edge_type") != "heuristic", F.struct("created_at", "edge_type")))
    return rows.groupBy("from_id", "to_id", "relationship").agg(F.coalesce(first["edge_type"], F.lit("heuristic")).alias("edge_type"))


def edges_mentioned_in(index: DataFrame) -> DataFrame:
    return index.select("entity_type", "entity_value", "note_id", F.lit("MENTIONED_IN").alias("relationship"))


def rule_edges(index: DataFrame, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(from_type, from_value, relationship, to_type, to_value, note_id): edges between entities of one note, by rule."""
    rules = [r for r in EDGE_RULES if relations is None or r[2] in relations]
    index = cut(index.where(F.col("entity_type").isin(*{t for r in rules for t in r[:2]})).select("entity_type", "entity_value", "note_id"))  # joined with itself
    table = F.broadcast(index.sparkSession.createDataFrame(rules, "from_type string, to_type string, relationship string"))  # one row per rule
    left = index.select(F.col("entity_type").alias("from_type"), F.col("entity_value").alias("from_value"), "note_id").join(table, "from_type")
    right = index.select(F.col("entity_type").alias("to_type"), F.col("entity_value").alias("to_value"), "note_id")
    return left.join(right, ["note_id", "to_type"]).select("from_type", "from_value", "relationship", "to_type", "to_value", "note_id")


def causal_triples(completions: DataFrame) -> DataFrame:
    """(note_id, subject, relation, object) from JSON completions: an array of arrays or of objects; known relations only."""
    lists = F.from_json("json", "array<array<string>>")
    objects = F.from_json("json", "array<struct<subject:string,relation:string,object:string>>")
    as_lists = F.filter(F.coalesce(lists, F.array().cast("array<array<string>>")), lambda x: F.size(x) >= 3)
    as_objects = F.filter(F.coalesce(objects, F.array().cast("array<struct<subject:string,relation:string,object:string>>")), lambda x: x["subject"].isNotNull() & x["object"].isNotNull())
    from_lists = F.transform(as_lists, lambda x: F.struct(F.get(x, F.lit(0)).alias("subject"), F.lower(F.get(x, F.lit(1))).alias("relation"), F.get(x, F.lit(2)).alias("object")))
    from_objects = F.transform(as_objects, lambda x: F.struct(x["subject"].alias("subject"), F.lower(x["relation"]).alias("relation"), x["object"].alias("object")))
    rows = completions.select("note_id", F.explode(F.concat(from_lists, from_objects)).alias("t")).select("note_id", "t.subject", "t.relation", "t.object")
    return rows.where(F.col("relation").isin(*CAUSAL_RELATIONS))


# fixed values: relations a causal triple may have
CAUSAL_RELATIONS = ("causes", "enables", "targets", "uses", "exploits", "attributed_to", "related_to")


def causal_edges(triples: DataFrame) -> DataFrame:
    """Causal edges (note_id, from_type, from_value, relation, to_type, to_value, edge_type) of triples: types by the words, objects under the name their aliases share."""
    to_type = infer_entity_type(F.replace(F.col("object"), F.lit("-"), F.lit(" ")))
    typed = triples.select("note_id", "relation", infer_entity_type(F.col("subject")).alias("from_type"), F.lower("subject").alias("from_value"), to_type.alias("to_type"), F.lower("object").alias("to_value"))
    named = resolve_alias(typed.select("*", F.lit("actor").alias("entity_type"), F.col("to_value").alias("entity_value")))
    return named.select("note_id", "from_type", "from_value", "relation", "to_type", F.col("canonical").alias("to_value"), F.lit("causal").alias("edge_type"))


def neighbors(edges: DataFrame, starts: DataFrame, relationship: str | None = None, tasks: int | None = None) -> DataFrame:
    """(from_id, relationship, to_id) out of the nodes of ``starts`` (node).

    ``tasks``: over how many edges and starts are dealt, by default as many as the session's shuffles have. Edges stream past
    the starts of a task and are made distinct there.
    """
    kept = (edges.where(F.col("relationship") == relationship) if relationship else edges).select("from_id", "relationship", "to_id")
    nodes = starts.select(F.col("node").alias("from_id"))
    if tasks:
        kept, nodes = kept.repartition(tasks, "from_id"), nodes.repartition(tasks, "from_id").hint("shuffle_hash")
    return kept.join(nodes, "from_id", "left_semi").distinct()


def traverse_paths(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, hops, path: array of (from_id, relationship, to_id)): walks of up to ``depth`` edges out of each start.

    A node is expanded once for a start, along the least of its shortest paths; edges back to nodes that were reached before
    end a path of their own.
    """
    links = edges.select("from_id", "relationship", "to_id").distinct()
    links = links.select(F.col("from_id").alias("node"), F.struct("from_id", "relationship", "to_id").alias("edge"))
    frontier = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("path", F.array().cast("array<struct<from_id:string,relationship:string,to_id:string>>"))
    seen, out = frontier.select("start", "node"), None
    for hop in range(1, depth + 1):
        step = cut(frontier.join(links, "node").select("start", F.lit(hop).alias("hops"), F.concat("path", F.array("edge")).alias("path")))
        out = step if out is None else out.union(step)
        if hop < depth:
            ends = step.groupBy("start", F.element_at("path", -1)["to_id"].alias("node")).agg(F.min("path").alias("path"))
            frontier = ends.join(seen, ["start", "node"], "left_anti")
            seen = seen.union(frontier.select("start", "node"))
    return out


def path_text(path: Column) -> Column:
    """A path of ``traverse_paths`` as text: from -[relationship]-> to -[relationship]-> to."""
    return F.concat(F.get(path, F.lit(0))["from_id"], F.array_join(F.transform(path, lambda e: F.concat(F.lit(" -["), e["relationship"], F.lit("]-> "), e["to_id"])), ""))


def graph_retrieve(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, note, hops, score): notes within ``depth`` hops of a query's nodes (query_id, node), at 1 / (1 + hops).

    An edge counts in both directions. A query's nodes start one frontier, which meets each direction on its own, so that no
    table of all edges both ways is made.
    """
    ways = [edges.select(F.col(a).alias("node"), F.col(b).alias("next")) for a, b in (("from_id", "to_id"), ("to_id", "from_id"))]
    best = frontier = cut(starts.select("query_id", "node", F.lit(0).alias("hops")).distinct())
    for hop in range(1, depth + 1):
        step = [frontier.join(way, "node").select("query_id", F.col("next").alias("node")).distinct() for way in ways]
        new = step[0].union(step[1]).distinct().join(best.select("query_id", "node"), ["query_id", "node"], "left_anti")
        frontier = cut(new.withColumn("hops", F.lit(hop)))
        best = best.union(frontier)
    return best.where(F.col("node").startswith("note:")).select("query_id", F.col("node").alias("note"), "hops", (1 / (1 + F.col("hops"))).alias("score"))


def causal_chain(edges: DataFrame, starts: DataFrame, forward: bool = True, max_depth: int = 3, max_visited: int = 50) -> DataFrame:
    """(start, depth, from_id, relationship, to_id): causal edges by breadth-first search from each start.

    A node at ``max_depth`` is still expanded; a start visits at most ``max_visited`` nodes, in order of depth and id.
    """
    causal = cut(edges.where("edge_type = 'causal'").select("from_id", "relationship", "to_id").distinct())  # read at each depth
    here, there = ("from_id", "to_id") if forward else ("to_id", "from_id")
    seen = starts.select(F.col("node").alias("start"), "node").distinct()
    frontier, out = seen, None
    for depth in range(max_depth + 1):
        step = cut(frontier.join(causal, F.col("node") == F.col(here)).select("start", F.lit(depth).alias("depth"), "from_id", "relationship", "to_id"))
        out = step if out is None else out.union(step)
        new = step.select("start", F.col(there).alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        have = seen.groupBy("start").agg(F.count("*").alias("have"))
        rank = F.row_number().over(Window.partitionBy("start").orderBy("node"))
        frontier = new.withColumn("k", rank).join(have, "start").where(F.col("k") + F.col("have") <= max_visited).select("start", "node")
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return out.distinct()


def provenance_chain(chain: DataFrame) -> DataFrame:
    """``causal_chain`` rows as text: from -relationship-> to."""
    return chain.select("start", "depth", F.concat_ws(" ", "from_id", F.concat(F.lit("-["), "relationship", F.lit("]->")), "to_id").alias("step"))


def entity_timeline(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, k, relationship, to_id, at): temporal and supersession edges of each node, in order of time."""
    rows = edges.where("relationship = 'SUPERSEDES' OR relationship LIKE 'TEMPORAL%'").join(starts.select(F.col("node").alias("from_id")), "from_id", "left_semi")
    at = F.coalesce("property_ts", "created_at") if "property_ts" in edges.columns else F.col("created_at")
    rows = rows.select(F.col("from_id").alias("node"), "relationship", "to_id", at.alias("at"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("at", "to_id")))


def changes_since(edges: DataFrame, since: str) -> DataFrame:
    at = F.coalesce("property_ts", "created_at") if "property_ts" in edges.columns else F.col("created_at")
    rows = edges.where("relationship = 'SUPERSEDES' OR relationship LIKE 'TEMPORAL%'").withColumn("at", at)
    return rows.where(F.col("at") >= F.lit(since).cast("timestamp")).select("from_id", "relationship", "to_id", "at")


def latest_state(edges: DataFrame) -> DataFrame:
    """(node, to_id, at): the last timeline entry of each node."""
    rows = edges.where("relationship = 'SUPERSEDES' OR relationship LIKE 'TEMPORAL%'")
    last = rows.groupBy(F.col("from_id").alias("node")).agg(F.max(F.struct(F.col("created_at").alias("at"), "to_id")).alias("x"))
    return last.select("node", "x.to_id", "x.at")


def add_temporal_edges(events: DataFrame) -> DataFrame:
    """Edges with a time property from (from_id, to_id, relationship, ts)."""
    return events.select("from_id", "to_id", F.concat(F.lit("TEMPORAL_"), F.upper("relationship")).alias("relationship"), F.lit("heuristic").alias("edge_type"), F.create_map(F.lit("timestamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("properties"), F.col("ts").alias("created_at"))


def parse_timestamp(text):
    """ISO 8601 with Z, then four formats, else null."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(node, kind, value, degree_out, degree_in) of every endpoint."""
    ends = edges.select(F.col("from_id").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("to_id", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("degree_out"), F.sum("i").alias("degree_in")).select("node", F.split_part("node", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("node", F.lit(":"), F.lit(2)).alias("value"), "degree_out", "degree_in")


def normalize_edge_schema(rows: DataFrame) -> DataFrame:
    """Legacy keys (source_id, target_id, relation_type) under their new names; rows without an id, end or relation go."""
    pick = lambda new, old: F.coalesce(new, old).alias(new)
    return rows.select("edge_id", pick("from_id", "source_id"), pick("to_id", "target_id"), pick("relationship", "relation_type")).dropna()


def migrate_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges re-keyed to (type, value) by their nodes, and those with an end that no node has."""
    at = lambda end: nodes.select(F.col("old_id").alias(f"{end}_id"), F.col("entity_type").alias(f"{end}_type"), F.col("entity_value").alias(f"{end}_value"))
    joined = edges.join(at("from"), "from_id", "left").join(at("to"), "to_id", "left")
    whole = F.col("from_type").isNotNull() & F.col("to_type").isNotNull()
    return joined.where(whole).select("from_type", "from_value", "relationship", "to_type", "to_value"), joined.where(~whole).select("from_id", "to_id", "relationship")
