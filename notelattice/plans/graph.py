"""Queries on building and walking the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import EDGE_RULES, PATTERNS
from ..operators import extract, graph
from ..operators.index import build_entity_index
from .derived import Tables, with_tables
from .notes import INDEX, IOCS, NOTES, entity_index, values_sql
from .registry import add

KG = with_tables("kg_edges")


def _observed(t: Tables) -> DataFrame:
    return t.orders.select(F.lit("actor").alias("entity_type"), F.concat(F.lit("apt"), F.col("o_custkey")).alias("entity_value"), F.when(F.col("o_orderkey") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.concat(F.lit("p"), F.col("o_orderkey") % 2), F.col("o_orderpriority"))).alias("properties"), (F.unix_timestamp("o_orderdate") * 1_000_000 + F.col("o_orderkey")).alias("ts"))


OBSERVED = "WITH o AS (SELECT 'apt' || o_custkey AS entity_value, o_orderkey % 3 = 0 AS none, 'p' || (o_orderkey % 2) AS k, o_orderpriority AS v, CAST(epoch(o_orderdate) AS BIGINT) * 1000000 + o_orderkey AS ts FROM orders)"
add("upsert_nodes", lambda t: graph.upsert_nodes(_observed(t)).select("entity_type", "entity_value", F.array_join(F.map_values("properties"), ",").alias("properties"), "created_at", "updated_at", "node_id"),
    f"{OBSERVED} SELECT 'actor' AS entity_type, entity_value, arg_max(v, ts) FILTER (WHERE NOT none) AS properties, min(ts) AS created_at, max(ts) AS updated_at, sha256('actor:' || entity_value) AS node_id FROM o GROUP BY entity_value")
add("upsert_nodes_merge", lambda t: graph.upsert_nodes(_observed(t), merge=True).select("entity_type", "entity_value", F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("properties"), "created_at", "updated_at"),
    f"{OBSERVED}, l AS (SELECT entity_value, k, arg_max(v, ts) AS v FROM o WHERE NOT none GROUP BY ALL), m AS (SELECT entity_value, string_agg(k || '=' || v, ',' ORDER BY k) AS properties FROM l GROUP BY 1) SELECT 'actor' AS entity_type, o.entity_value, coalesce(any_value(properties), '') AS properties, min(ts) AS created_at, max(ts) AS updated_at FROM o LEFT JOIN m USING (entity_value) GROUP BY o.entity_value")


def _edge_rows(t: Tables) -> DataFrame:
    return t.kg_edges.withColumn("note_id", F.concat(F.lit("note_"), F.year("created_at")))


EDGE_ROWS = f"{KG}, e AS (SELECT *, 'note_' || year(created_at) AS note_id FROM kg_edges)"
SPECIFIC = "coalesce(arg_min(edge_type, created_at) FILTER (WHERE edge_type <> 'heuristic'), 'heuristic') AS edge_type"


def _edge_properties(t: Tables) -> DataFrame:
    """Observed edges whose properties tell the time, none on edges of causal type."""
    told = F.create_map(F.lit("at"), F.col("created_at").cast("string"))
    return _edge_rows(t).withColumn("properties", F.when(F.col("edge_type") == "causal", F.create_map().cast("map<string,string>")).otherwise(told))


add("upsert_edges", lambda t: graph.upsert_edges(_edge_properties(t)).withColumn("properties", F.date_format(F.col("properties")["at"].cast("timestamp"), "yyyy-MM-dd")), f"{EDGE_ROWS} SELECT from_id, to_id, relationship, note_id, strftime(max(created_at) FILTER (WHERE edge_type <> 'causal'), '%Y-%m-%d') AS properties, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS observations, {SPECIFIC} FROM e GROUP BY 1, 2, 3, 4")
add("promote_edge_type", lambda t: graph.promote_edge_type(t.kg_edges), f"{KG} SELECT from_id, to_id, relationship, {SPECIFIC} FROM kg_edges GROUP BY 1, 2, 3")
add("edges_mentioned_in", lambda t: graph.edges_mentioned_in(entity_index(t)), f"{INDEX} SELECT *, 'MENTIONED_IN' AS relationship FROM entity_index")


def _people(t: Tables, relations: tuple[str, ...]) -> DataFrame:
    """The types that the rules of ``relations`` need, found in each note's text or such as a model might have found."""
    needed = {x for a, b, r in EDGE_RULES if r in relations for x in (a, b)}
    n = t.notes.where("domain <> 'cti'")
    pairs = (("person", "ana"), ("organization", "acme"), ("event", "expo"), ("location", "paris"), ("activity", "hiking"), ("temporal", "monday"), ("malware", "emotet"), ("asset", "server"), ("campaign", "operation-x"))
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.lit(v), (F.col("importance") % (i + 2)).cast("string")).alias("v")) for i, (k, v) in enumerate(pairs)])
    made = n.select("note_id", F.explode(kinds).alias("x")).select(F.col("x.k").alias("entity_type"), F.col("x.v").alias("entity_value"), "note_id")
    kinds = tuple(k for k in PATTERNS if k in needed)
    made = made.where(F.col("entity_type").isin(*needed))
    return made if not kinds else build_entity_index(extract.extract_all_long(t.notes, kinds=kinds)).union(made)


_MADE = " UNION ALL ".join(f"SELECT '{k}', '{v}' || (importance % {i + 2}), note_id FROM notes WHERE domain <> 'cti'" for i, (k, v) in enumerate((("person", "ana"), ("organization", "acme"), ("event", "expo"), ("location", "paris"), ("activity", "hiking"), ("temporal", "monday"), ("malware", "emotet"), ("asset", "server"), ("campaign", "operation-x"))))
FULL = f"{INDEX}, full_index AS (SELECT * FROM entity_index UNION ALL {_MADE})"


def _rules_sql(relations: tuple[str, ...]) -> str:
    rules = ", ".join(f"('{a}', '{b}', '{r}')" for a, b, r in EDGE_RULES if r in relations)
    types = ", ".join(sorted({f"'{x}'" for a, b, r in EDGE_RULES if r in relations for x in (a, b)}))
    needed = {x for a, b, r in EDGE_RULES if r in relations for x in (a, b)}
    kinds = [k for k in PATTERNS if k in needed]
    found = " UNION ALL ".join(f"SELECT '{k}' AS entity_type, entity_value, note_id FROM ({values_sql(k)}) e" for k in kinds) or "SELECT '' AS entity_type, '' AS entity_value, '' AS note_id WHERE false"
    full = f"{NOTES}, full_index AS (SELECT DISTINCT entity_type, entity_value, note_id FROM ({found}) f UNION ALL {_MADE})"
    return f"{full}, typed AS MATERIALIZED (SELECT * FROM full_index WHERE entity_type IN ({types})), rules AS (SELECT * FROM (VALUES {rules}) v(from_type, to_type, relationship)) SELECT r.from_type, a.entity_value AS from_value, r.relationship, r.to_type, b.entity_value AS to_value, a.note_id FROM typed a JOIN rules r ON r.from_type = a.entity_type JOIN typed b ON b.note_id = a.note_id AND b.entity_type = r.to_type"


for _name, _relations in {
    "uses_tool": ("USES_TOOL",), "exploits_cve": ("EXPLOITS_CVE",), "targets_asset": ("TARGETS_ASSET",), "conducts_campaign": ("CONDUCTS_CAMPAIGN",), "uses_technique": ("USES_TECHNIQUE",),
    "implements": ("IMPLEMENTS",), "person": ("AFFILIATED_WITH", "ATTENDED", "LOCATED_AT", "PARTICIPATES_IN"), "event": ("HELD_AT", "ORGANIZED_BY", "OCCURRED_ON"), "org_based_in": ("BASED_IN",),
}.items():
    add(f"edges_{_name}", lambda t, r=_relations: graph.rule_edges(_people(t, r), r), _rules_sql(_relations))


def completions(t: Tables) -> DataFrame:
    lists = F.format_string('[["apt%d", "Uses", "mimikatz"], ["x", "likes", "y"], ["short"]]', F.col("importance"))
    objects = F.format_string('[{"subject": "cve-2024-%04d", "relation": "enables", "object": "Fancy-Bear"}]', F.col("importance"))
    return t.notes.select("note_id", "created_at", F.when(F.col("domain") == "cti", lists).when(F.col("domain") == "incident", objects).otherwise("no json").alias("json"))


TRIPLES = f"{NOTES}, triples AS (SELECT note_id, 'apt' || importance AS subject, 'uses' AS relation, 'mimikatz' AS object FROM notes WHERE domain = 'cti' UNION ALL SELECT note_id, 'cve-2024-' || lpad(CAST(importance AS VARCHAR), 4, '0'), 'enables', 'Fancy-Bear' FROM notes WHERE domain = 'incident')"
add("causal_triples", lambda t: graph.causal_triples(completions(t)), f"{TRIPLES} SELECT * FROM triples")


add("causal_edges", lambda t: graph.causal_edges(graph.causal_triples(completions(t))), f"{TRIPLES} SELECT note_id, CASE WHEN starts_with(subject, 'apt') THEN 'intrusion_set' ELSE 'cve' END AS from_type, subject AS from_value, relation, CASE object WHEN 'mimikatz' THEN 'tool' ELSE 'intrusion_set' END AS to_type, CASE object WHEN 'mimikatz' THEN 'mimikatz' ELSE 'apt28' END AS to_value, 'causal' AS edge_type FROM triples")
add("ingest_relationships", lambda t: graph.upsert_edges(_edge_rows(t).union(_edge_rows(t))).select("from_id", "to_id", "relationship", "note_id", "observations"), f"{EDGE_ROWS} SELECT from_id, to_id, relationship, note_id, 2 * count(*) AS observations FROM e GROUP BY 1, 2, 3, 4")
add("hunt_edges", lambda t: extract.technique_parent(t.notes).select("note_id", F.lit("MENTIONED_IN").alias("relationship"), F.col("technique").alias("target")).union(extract.hunt_iocs(t.notes, t.region.select(F.lit("none").alias("domain"))).select("note_id", F.lit("INDICATES"), "entity_value")),
    f"""{NOTES} SELECT DISTINCT note_id, 'MENTIONED_IN' AS relationship, split_part(v, '.', 1) AS target FROM (SELECT note_id, unnest(regexp_extract_all(content_raw, 'T\\d{{4}}(?:\\.\\d{{3}})?')) AS v FROM notes) x
UNION ALL SELECT note_id, 'INDICATES', entity_value FROM ({IOCS}) i""")  # fmt: skip


def _starts(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 50 = 0").select(F.concat(F.lit("actor:"), F.col("c_custkey")).alias("node"))


START = f"{KG}, starts AS (SELECT 'actor:' || c_custkey AS node FROM customer WHERE c_custkey % 50 = 0)"
add("neighbors", lambda t: graph.neighbors(t.kg_edges, t.customer.select(F.concat(F.lit("actor:"), F.col("c_custkey")).alias("node")), "USES_TOOL", t.tasks("lineitem")), f"{KG} SELECT DISTINCT from_id, relationship, to_id FROM kg_edges WHERE relationship = 'USES_TOOL' AND from_id IN (SELECT 'actor:' || c_custkey FROM customer)")
add("traverse_paths", lambda t: graph.traverse_paths(t.kg_edges, _starts(t), 2).select("start", "hops", graph.path_text(F.col("path")).alias("path")),
    f"""{START}, l AS (SELECT DISTINCT from_id, relationship, to_id FROM kg_edges), one AS (SELECT s.node AS start, from_id, relationship, to_id FROM starts s JOIN l ON from_id = s.node),
firsts AS (SELECT start, to_id AS node, min(relationship) AS relationship FROM one WHERE to_id <> start GROUP BY ALL)
SELECT start, 1 AS hops, start || ' -[' || relationship || ']-> ' || to_id AS path FROM one
UNION ALL SELECT start, 2, start || ' -[' || f.relationship || ']-> ' || node || ' -[' || l.relationship || ']-> ' || to_id FROM firsts f JOIN l ON from_id = node""")  # fmt: skip


def _query_nodes(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("actor:"), F.col("c_custkey")).alias("node"))


RETRIEVED = "l AS (SELECT from_id, to_id FROM kg_edges UNION SELECT to_id, from_id FROM kg_edges), w AS (SELECT node AS start, to_id AS node, 1 AS hops FROM starts JOIN l ON from_id = node UNION ALL SELECT s.node, b.to_id, 2 FROM starts s JOIN l a ON a.from_id = s.node JOIN l b ON b.from_id = a.to_id)"
add("graph_retrieve", lambda t: graph.graph_retrieve(t.kg_edges, _query_nodes(t)), f"{START}, {RETRIEVED} SELECT CAST(split_part(start, ':', 2) AS BIGINT) AS query_id, node AS note, min(hops) AS hops, 1 / (1 + min(hops)) AS score FROM w WHERE starts_with(node, 'note:') GROUP BY start, node")


def _chain_sql(forward: bool) -> str:
    here, there = ("from_id", "to_id") if forward else ("to_id", "from_id")
    start = "SELECT 'actor:' || c_custkey AS node FROM customer" if forward else "SELECT 'cve:' || s_suppkey AS node FROM supplier"
    sql = f"{KG}, c AS (SELECT DISTINCT from_id, relationship, to_id FROM kg_edges WHERE edge_type = 'causal'), s0 AS (SELECT DISTINCT node AS start, node FROM ({start}) x), f0 AS (SELECT * FROM s0)"
    for d in range(4):
        sql += f", e{d} AS (SELECT start, {d} AS depth, from_id, relationship, to_id FROM f{d} JOIN c ON {here} = node), n{d} AS (SELECT DISTINCT start, {there} AS node FROM e{d} EXCEPT SELECT * FROM s{d}), f{d + 1} AS (SELECT start, node FROM (SELECT n.*, row_number() OVER (PARTITION BY start ORDER BY node) AS k, h.have FROM n{d} n JOIN (SELECT start, count(*) AS have FROM s{d} GROUP BY 1) h USING (start)) r WHERE k + have <= 50), s{d + 1} AS (SELECT * FROM s{d} UNION ALL SELECT * FROM f{d + 1})"
    return sql + ", every AS (" + " UNION ".join(f"SELECT * FROM e{d}" for d in range(4)) + ")"


def _chain(t: Tables, forward: bool) -> DataFrame:
    start = t.customer.select(F.concat(F.lit("actor:"), F.col("c_custkey")).alias("node")) if forward else t.supplier.select(F.concat(F.lit("cve:"), F.col("s_suppkey")).alias("node"))
    return graph.causal_chain(t.kg_edges, start, forward)


add("causal_forward", lambda t: _chain(t, True), f"{_chain_sql(True)} SELECT * FROM every")
add("causal_backward", lambda t: _chain(t, False), f"{_chain_sql(False)} SELECT * FROM every")
add("provenance_chain", lambda t: graph.provenance_chain(_chain(t, True)), f"{_chain_sql(True)} SELECT start, depth, from_id || ' -[' || relationship || ']-> ' || to_id AS step FROM every")
add("add_temporal_edges", lambda t: graph.add_temporal_edges(t.events.select(F.col("user_id").cast("string").alias("from_id"), F.col("event_id").cast("string").alias("to_id"), F.col("event_type").alias("relationship"), "ts")).select("from_id", "to_id", "relationship", "edge_type", F.col("properties")["timestamp"].alias("at"), "created_at"),
    "SELECT CAST(user_id AS VARCHAR) AS from_id, CAST(event_id AS VARCHAR) AS to_id, 'TEMPORAL_' || upper(event_type) AS relationship, 'heuristic' AS edge_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, ts AS created_at FROM events")
SUPERSEDED = "relationship = 'SUPERSEDES' OR relationship LIKE 'TEMPORAL%'"
add("entity_timeline", lambda t: graph.entity_timeline(t.kg_edges, t.orders.select(F.concat(F.lit("note:"), F.col("o_orderkey")).alias("node"))), f"{KG} SELECT from_id AS node, relationship, to_id, created_at AS at, row_number() OVER (PARTITION BY from_id ORDER BY created_at, to_id) AS k FROM kg_edges WHERE {SUPERSEDED}")
add("changes_since", lambda t: graph.changes_since(t.kg_edges, "1997-01-01"), f"{KG} SELECT from_id, relationship, to_id, created_at AS at FROM kg_edges WHERE ({SUPERSEDED}) AND created_at >= TIMESTAMP '1997-01-01'")
add("latest_state", lambda t: graph.latest_state(t.kg_edges), f"{KG} SELECT from_id AS node, arg_max(to_id, created_at) AS to_id, max(created_at) AS at FROM kg_edges WHERE {SUPERSEDED} GROUP BY 1")
_FORMATS = ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "on %d %B")
_STAMPED = "list_extract([" + ", ".join(f"strftime(ts, '{f}')" for f in _FORMATS) + "], CAST(event_id % 6 AS INT) + 1)"
_SPARK_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "'on' dd MMMM")
add("parse_timestamp", lambda t: t.events.select("event_id", graph.parse_timestamp(F.element_at(F.array(*[F.date_format("ts", f) for f in _SPARK_FORMATS]), (F.col("event_id") % 6 + 1).cast("int"))).alias("at")),
    "SELECT event_id, CASE WHEN event_id % 6 < 3 THEN date_trunc('second', ts) WHEN event_id % 6 < 5 THEN date_trunc('day', ts) END AS at FROM events")
add("graph_nodes", lambda t: graph.graph_nodes(t.kg_edges), f"{KG}, e AS (SELECT from_id AS node, 1 AS o, 0 AS i FROM kg_edges UNION ALL SELECT to_id, 0, 1 FROM kg_edges) SELECT node, split_part(node, ':', 1) AS kind, split_part(node, ':', 2) AS value, CAST(sum(o) AS BIGINT) AS degree_out, CAST(sum(i) AS BIGINT) AS degree_in FROM e GROUP BY node")
add("graph_edges", lambda t: t.kg_edges.select("from_id", "relationship", "to_id", "edge_type"), f"{KG} SELECT from_id, relationship, to_id, edge_type FROM kg_edges")


def _legacy(t: Tables) -> DataFrame:
    old = F.col("l_orderkey") % 2 == 0
    a, b = F.concat(F.lit("o"), F.col("l_orderkey")), F.when(F.col("l_linenumber") != 5, F.concat(F.lit("p"), F.col("l_partkey")))
    return t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.when(~old, a).alias("from_id"), F.when(~old, b).alias("to_id"), F.when(~old, F.col("l_returnflag")).alias("relationship"), F.when(old, a).alias("source_id"), F.when(old, b).alias("target_id"), F.when(old, F.col("l_returnflag")).alias("relation_type"))


add("normalize_edge_schema", lambda t: graph.normalize_edge_schema(_legacy(t)), "SELECT l_orderkey || '-' || l_linenumber AS edge_id, 'o' || l_orderkey AS from_id, 'p' || l_partkey AS to_id, l_returnflag AS relationship FROM lineitem WHERE l_linenumber <> 5")


def _migrate(t: Tables) -> DataFrame:
    nodes = t.part.where("p_partkey % 10 <> 0").select(F.concat(F.lit("tool:"), F.col("p_partkey")).alias("old_id"), F.lit("tool").alias("entity_type"), F.col("p_name").alias("entity_value")).union(t.customer.select(F.concat(F.lit("actor:"), F.col("c_custkey")), F.lit("actor"), F.col("c_name")))
    return graph.migrate_edges(t.kg_edges.where("relationship = 'USES_TOOL'"), nodes)[0]


add("migrate_kg", _migrate, f"{KG} SELECT 'actor' AS from_type, c_name AS from_value, relationship, 'tool' AS to_type, p_name AS to_value FROM kg_edges JOIN customer ON from_id = 'actor:' || c_custkey JOIN part ON to_id = 'tool:' || p_partkey AND p_partkey % 10 <> 0 WHERE relationship = 'USES_TOOL'")
