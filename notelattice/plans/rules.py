"""Queries on detection rules, the ontology, synthesis and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut
from ..operators import ontology, rules, synthesis
from ..sources import tables
from .derived import Tables, with_tables
from .notes import NOTES, quoted
from .registry import add
from .retrieve import RANKED, _ranked

TAGS = ("attack.t1059.001", "attack.G0007", "attack.s0154.x", "attack.execution", "cve.2024.3094", "cve.2024-1111", "tlp.red", "plain")


def _pick(values: tuple[str, ...], column: str = "p_partkey"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...]) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(p_partkey % {len(values)} + 1 AS INT))"


def _tags(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("rule_id"), _pick(TAGS).alias("tag"))


_KIND = ("AttackPattern", "IntrusionSet", "Malware", None, "Vulnerability", "Vulnerability", None, None)
_VALUE = ("T1059.001", "G0007", "S0154", None, "CVE-2024-3094", "CVE-2024-1111", None, None)
_LIST = lambda values: "list_extract([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"], CAST(p_partkey % {len(values)} + 1 AS INT))"
SIGMA = f"WITH r AS (SELECT p_partkey AS rule_id, {_pick_sql(TAGS)} AS tag, {_LIST(_KIND)} AS entity_type, {_LIST(_VALUE)} AS entity_value FROM part)"
add("sigma_tag_resolve", lambda t: rules.sigma_tag_resolve(_tags(t)), f"{SIGMA} SELECT * FROM r")
add("sigma_tag_edges", lambda t: rules.sigma_tag_edges(_tags(t)), f"{SIGMA} SELECT rule_id, 'tagged_with' AS rel, 'SigmaTag' AS to_type, tag AS to_value FROM r UNION ALL SELECT rule_id, CASE entity_type WHEN 'AttackPattern' THEN 'detects' WHEN 'Vulnerability' THEN 'references_cve' ELSE 'attributed_to' END, entity_type, entity_value FROM r WHERE entity_type IS NOT NULL")
add("sigma_logsource_edges", lambda t: rules.sigma_logsource_edges(t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("product"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("service"), F.lit("").alias("category"))), "SELECT p_partkey AS rule_id, 'applies_to' AS rel, 'product:' || p_brand AS to_value FROM part UNION ALL SELECT p_partkey, 'applies_to', 'service:' || p_type FROM part WHERE p_size > 25")
add("sigma_related_edges", lambda t: rules.sigma_related_edges(t.lineitem.select(F.col("l_partkey").alias("rule_id"), F.when(F.col("l_linenumber") < 6, F.col("l_suppkey").cast("string")).alias("other_id"), F.when(F.col("l_returnflag") == "R", "Obsolete").otherwise("similar").alias("type"))), "SELECT l_partkey AS rule_id, CASE l_returnflag WHEN 'R' THEN 'superseded_by' ELSE 'related_to' END AS rel, CAST(l_suppkey AS VARCHAR) AS to_value FROM lineitem WHERE l_linenumber < 6")
DOCS = ('{"title": "a", "logsource": {"product": "x"}, "detection": {"condition": "s"}}', '{"title": "b", "correlation": {"type": "count"}}', '{"title": "c", "filter": {}, "logsource": {}}', '{"title": "d"}')


def _sigma(t: Tables) -> DataFrame:
    return t.part.select(F.when(F.col("p_size") > 10, F.concat(F.lit("id-"), "p_partkey")).alias("id"), F.when(F.col("p_size") != 20, F.col("p_name")).alias("title"), _pick(("low", "HIGH", "odd")).alias("level"), F.concat(_pick(DOCS), F.format_string("%8d", "p_partkey")).alias("document"))


_DOC = f"{_pick_sql(DOCS)} || lpad(CAST(p_partkey AS VARCHAR), 8, ' ')"
_ID = f"CASE WHEN p_size > 10 THEN 'id-' || p_partkey ELSE 'sigma_' || substr(sha256({_DOC}), 1, 16) END"
_FULL = '{"title": "t", "description": "about", "author": "me", "date": "2024-01-01", "references": ["a", "b"], "tags": ["attack.t1059"], "status": "test", "logsource": {"product": "windows", "category": "process"}, "detection": {"x": "y"}, "fields": ["f"], "falsepositives": ["none", "few"]}'


def _sigma_columns(t: Tables) -> DataFrame:
    """Every other rule with a whole document; lists as text."""
    given = _sigma(t).withColumn("document", F.when(F.length("document") % 2 == 0, F.lit(_FULL)).otherwise(F.col("document")))
    out = rules.sigma_project(given)
    return out.withColumns({k: F.array_join(k, ",") for k in ("references", "tags", "fields", "falsepositives")})


_FULLSQL = lambda v, other="NULL": f"CASE WHEN even THEN '{v}' ELSE {other} END"
add("sigma_project", _sigma_columns, f"""WITH d AS (SELECT *, {_DOC} AS given FROM part), x AS (SELECT *, length(given) % 2 = 0 AS even, CASE WHEN length(given) % 2 = 0 THEN {quoted(_FULL)} ELSE given END AS doc FROM d)
SELECT CASE WHEN p_size > 10 THEN 'id-' || p_partkey ELSE 'sigma_' || substr(sha256(doc), 1, 16) END AS rule_id, CASE WHEN p_size <> 20 THEN p_name ELSE '' END AS title, 'sigma' AS source_format, sha256(doc) AS content_sha256,
{_FULLSQL('about')} AS description, {_FULLSQL('me')} AS author, {_FULLSQL('2024-01-01')} AS date, NULL AS modified, NULL AS license, {_FULLSQL('a,b', "''")} AS "references", {_FULLSQL('attack.t1059', "''")} AS tags,
list_extract(['low', 'HIGH', 'odd'], CAST(p_partkey % 3 + 1 AS INT)) AS level, {_FULLSQL('test')} AS status, {_FULLSQL('windows', "CASE p_partkey % 4 WHEN 0 THEN 'x' END")} AS logsource_product, NULL AS logsource_service, {_FULLSQL('process')} AS logsource_category,
list_extract(['low', 'HIGH', 'odd'], CAST(p_partkey % 3 + 1 AS INT)) AS rule_level, {_FULLSQL('test')} AS rule_status, {_FULLSQL('{"x":"y"}', "CASE p_partkey % 4 WHEN 0 THEN '{\"condition\":\"s\"}' WHEN 1 THEN '{\"type\":\"count\"}' END")} AS detection_body,
CASE WHEN even THEN 'detection' ELSE list_extract(['detection', 'correlation', 'filter', 'detection'], CAST(p_partkey % 4 + 1 AS INT)) END AS rule_type, {_FULLSQL('f', "''")} AS fields, {_FULLSQL('none,few', "''")} AS falsepositives FROM x""")
add("sigma_validate", lambda t: rules.sigma_validate(_sigma(t)).select("rule_id", F.array_join("errors", ";").alias("errors")),
    f"""SELECT {_ID} AS rule_id, concat_ws(';', CASE WHEN p_size = 20 THEN 'title: required' END, CASE WHEN p_partkey % 4 = 3 THEN 'logsource: required' END,
CASE WHEN p_partkey % 4 > 1 THEN 'detection.condition: required' END, CASE WHEN p_partkey % 3 = 2 THEN 'level: not allowed' END) AS errors FROM part""")  # fmt: skip
add("sigma_note", lambda t: rules.sigma_note(_sigma(t).withColumn("rule_id", F.coalesce("id", F.lit("none")))),
    f"""SELECT 'sigma:' || CASE WHEN p_size > 10 THEN 'id-' || p_partkey ELSE 'none' END || ':' || substr(sha256({_DOC}), 1, 12) AS source_ref,
concat_ws(chr(10), CASE WHEN p_size <> 20 THEN 'Sigma rule: ' || p_name || ' (' || list_extract(['low', 'HIGH', 'odd'], CAST(p_partkey % 3 + 1 AS INT)) || ')' END, {_DOC}) AS content FROM part""")  # fmt: skip
YTAGS = ("T1059", "attack.t1059.001", "CVE_2021_44228", "cve-2024-12345", "apt", "Webshell", "my_tag")
_YK = ("AttackPattern", "AttackPattern", "Vulnerability", "Vulnerability", "YaraTag", "YaraTag", "YaraTag")
_YV = ("T1059", "T1059.001", "CVE-2021-44228", "CVE-2024-12345", "APT", "WEBSHELL", "my_tag")
_YN = (None, None, None, None, "category", "category", "freeform")
add("yara_tag_resolve", lambda t: rules.yara_tag_resolve(t.part.select(F.col("p_partkey").alias("rule_id"), _pick(YTAGS).alias("tag"))), f"SELECT p_partkey AS rule_id, {_pick_sql(YTAGS)} AS tag, {_LIST(_YK)} AS entity_type, {_LIST(_YV)} AS entity_value, {_LIST(_YN)} AS namespace FROM part")


def _yara(t: Tables) -> DataFrame:
    meta = F.create_map(F.lit("id"), F.when(F.col("p_size") > 5, F.format_string("%016d", "p_partkey")).otherwise(""), F.lit("version"), F.when(F.col("p_size") % 2 == 0, "1.0").otherwise("one"), F.lit("mitre_att"), F.lit("t1059; T1027"), F.lit("technique"), F.when(F.col("p_size") > 30, "loader").otherwise(""), F.lit("actor"), F.when(F.col("p_size") > 40, "APT28").otherwise(""), F.lit("author"), F.lit("a"), F.lit("description"), F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("name"), F.col("p_name").alias("raw"), meta.alias("meta"), F.array(_pick(YTAGS)).alias("tags"), "p_size")


def _yara_columns(t: Tables) -> DataFrame:
    raw = F.concat(F.when(F.col("p_size") % 2 == 0, "private ").otherwise("global private "), F.lit("rule r"), F.lit(" {\n strings:\n $a = \"x\"\n condition:\n  any of them\n}"))
    more = F.map_concat("meta", F.create_map(F.lit("status"), F.lit("RELEASED"), F.lit("sharing"), F.lit("TLP:CLEAR"), F.lit("hash"), F.when(F.col("p_size") > 20, "h1").otherwise("")))
    out = rules.yara_project(_yara(t).withColumn("raw", raw).withColumn("meta", more).withColumn("rule_number", F.col("rule_id")))
    return out.withColumns({k: F.array_join(k, ",") for k in ("references", "tags", "hash_of_sample")})


_RAW = "CASE WHEN p_size % 2 = 0 THEN 'private ' ELSE 'global private ' END || 'rule r {' || chr(10) || ' strings:' || chr(10) || ' $a = \"x\"' || chr(10) || ' condition:' || chr(10) || '  any of them' || chr(10) || '}'"
add("yara_project", _yara_columns, f"""WITH y AS (SELECT *, {_RAW} AS raw FROM part) SELECT CASE WHEN p_size > 5 THEN lpad(CAST(p_partkey AS VARCHAR), 16, '0') ELSE 'yara_' || substr(sha256(raw), 1, 16) END AS rule_id, p_name AS title, 'yara' AS source_format, sha256(raw) AS content_sha256,
p_name AS description, 'a' AS author, NULL AS date, NULL AS modified, '' AS "references", {_pick_sql(YTAGS)} AS tags, 'released' AS status, 'TLP:CLEAR' AS tlp, p_name AS name, CASE WHEN p_size > 5 THEN lpad(CAST(p_partkey AS VARCHAR), 16, '0') END AS cccs_id,
NULL AS fingerprint, NULL AS category, CASE WHEN p_size > 30 THEN 'loader' END AS technique_tag, CASE WHEN p_size % 2 = 0 THEN '1.0' ELSE 'one' END AS cccs_version, CASE WHEN p_size > 20 THEN 'h1' ELSE '' END AS hash_of_sample,
true AS is_private, p_size % 2 <> 0 AS is_global, 'any of them' AS condition FROM y""")
add("yara_edges", lambda t: rules.yara_edges(_yara(t)), f"SELECT p_partkey AS rule_id, 'detects' AS rel, 'AttackPattern' AS to_type, unnest(['T1059', 'T1027']) AS to_value FROM part UNION ALL SELECT p_partkey, 'tagged_with', 'YaraTag', 'loader' FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey, 'attributed_to', 'ThreatActor', 'APT28' FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, CASE {_LIST(_YK)} WHEN 'AttackPattern' THEN 'detects' WHEN 'Vulnerability' THEN 'references_cve' ELSE 'tagged_with' END, {_LIST(_YK)}, {_LIST(_YV)} FROM part")
_HARD = "array_to_string(list_filter([CASE WHEN p_size <= 5 THEN 'missing required CCCS field: id' END, 'missing required CCCS field: fingerprint', 'missing required CCCS field: modified', 'missing required CCCS field: status', 'missing required CCCS field: sharing', 'missing required CCCS field: source', 'missing required CCCS field: category', CASE WHEN p_size <= 5 THEN 'id: empty value' END, CASE WHEN p_size % 2 <> 0 THEN 'version: wrong form' END], lambda x: x IS NOT NULL), ';')"
add("cccs_validate", lambda t: rules.cccs_validate(_yara(t), "strict").select("rule_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "accepted"), f"SELECT p_partkey AS rule_id, {_HARD} AS errors, 'mitre_att: wrong form' AS warnings, false AS accepted FROM part")
add("cccs_tier_gate", lambda t: rules.cccs_tier_gate(rules.cccs_validate(_yara(t), "warn"), "warn").select("rule_id", "compliance", "accepted"), "SELECT p_partkey AS rule_id, 'warn' AS compliance, true AS accepted FROM part")
ANSWERS = ('{"summary": "s", "mechanism": "m", "related_techniques": ["T1", "T2"], "confidence": 3}', '{"confidence": "0.5"}', "no json")
add("rule_explanation_coerce", lambda t: rules.rule_explanation_coerce(t.part.select(F.col("p_partkey").alias("rule_id"), _pick(ANSWERS).alias("json"))).withColumn("related_techniques", F.array_join("related_techniques", ",")), f"SELECT p_partkey AS rule_id, {_LIST(('s', 'explanation unavailable: missing summary', 'explanation unavailable: missing summary'))} AS summary, {_LIST(('m', '', ''))} AS mechanism, {_LIST(('T1,T2', '', ''))} AS related_techniques, list_extract([1.0, 0.5, 0.0], CAST(p_partkey % 3 + 1 AS INT)) AS confidence FROM part")
add("rule_prompt_prepare", lambda t: rules.rule_prompt_prepare(t.documents.select(F.col("doc_id").alias("rule_id"), F.concat(F.lit("</rule>"), "text").alias("document"))), "SELECT doc_id AS rule_id, replace(substr('</rule>' || text, 1, 8192), '</rule>', '<\\/rule>') AS body FROM documents")

# ontology
_TYPES = ("Person", "Task", "Event", "Unknown")


def _entities(t: Tables) -> DataFrame:
    props = F.create_map(F.lit("name"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(""), F.lit("title"), F.col("p_name"), F.lit("start"), F.lit("2024-02-01"), F.lit("end"), F.when(F.col("p_size") > 45, "2024-01-01").otherwise("2024-03-01"))
    return t.part.select(F.concat(F.lit("e"), "p_partkey").alias("id"), _pick(_TYPES).alias("type"), props.alias("properties"))


ENTITIES = f"WITH e AS (SELECT 'e' || p_partkey AS id, {_pick_sql(_TYPES)} AS type, p_name, p_size FROM part)"
def _types(t: Tables) -> DataFrame:
    """Built-in types under a user's for events, which order their times, forbid a name for short names and list titles."""
    user = t.spark.createDataFrame([("Event", ["title", "start"], ["secret"], {"name": ["red", "blue"]}, True), ("Task", ["title"], ["name"], {}, False)], ontology.TYPE_SCHEMA)
    return ontology.schema_overlay(ontology.entity_types(t.spark), user, "type")


add("validate_entities", lambda t: ontology.validate_entities(_entities(t)), f"{ENTITIES}, m AS (SELECT id, CASE WHEN type = 'Person' AND p_size <= 10 THEN 'name' WHEN type = 'Task' THEN 'status' ELSE '' END AS missing FROM e) SELECT id, missing, '' AS forbidden, '' AS invalid, false AS ends_early, missing = '' AS valid FROM m")
add("validate_entities_user_types", lambda t: ontology.validate_entities(_entities(t), _types(t)), f"{ENTITIES}, m AS (SELECT id, CASE WHEN type = 'Person' AND p_size <= 10 THEN 'name' ELSE '' END AS missing, CASE type WHEN 'Task' THEN 'name' ELSE '' END AS forbidden, CASE type WHEN 'Event' THEN 'name' ELSE '' END AS invalid, type = 'Event' AND p_size > 45 AS ends_early FROM e) SELECT *, missing || forbidden || invalid = '' AND NOT ends_early AS valid FROM m")
_RELS = ("has_assignee", "blocks", "custom")


def _relations(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat(F.lit("e"), "l_partkey").alias("from_id"), F.concat(F.lit("e"), "l_suppkey").alias("to_id"), _pick(_RELS, "l_linenumber").alias("rel"), _pick(_TYPES, "l_partkey").alias("from_type"), _pick(_TYPES, "l_suppkey").alias("to_type"))


RELATIONS = "WITH r AS (SELECT 'e' || l_partkey AS from_id, 'e' || l_suppkey AS to_id, list_extract(['has_assignee', 'blocks', 'custom'], CAST(l_linenumber % 3 + 1 AS INT)) AS rel, list_extract(['Person', 'Task', 'Event', 'Unknown'], CAST(l_partkey % 4 + 1 AS INT)) AS from_type, list_extract(['Person', 'Task', 'Event', 'Unknown'], CAST(l_suppkey % 4 + 1 AS INT)) AS to_type FROM lineitem)"
add("validate_relations", lambda t: ontology.validate_relations(_relations(t)), f"{RELATIONS} SELECT *, CASE rel WHEN 'has_assignee' THEN from_type = 'Task' AND to_type = 'Person' WHEN 'blocks' THEN from_type = 'Task' AND to_type = 'Task' ELSE true END AS valid FROM r")
add("referential_check", lambda t: ontology.referential_check(_relations(t), _entities(t).where("type <> 'Unknown'")), f"{RELATIONS}, e AS (SELECT 'e' || p_partkey AS id FROM part WHERE p_partkey % 4 <> 3) SELECT from_id, rel, to_id, f.id IS NULL AS no_from, t.id IS NULL AS no_to FROM r LEFT JOIN e f ON f.id = from_id LEFT JOIN e t ON t.id = to_id WHERE f.id IS NULL OR t.id IS NULL")
add("entities_by_type", lambda t: ontology.entities_by_type(_entities(t), "Task").select("id"), f"{ENTITIES} SELECT id FROM e WHERE type = 'Task'")
add("entities_by_property", lambda t: ontology.entities_by_property(_entities(t), "end", "2024-01-01").select("id"), f"{ENTITIES} SELECT id FROM e WHERE p_size > 45")
add("list_types", lambda t: _entities(t).select("type").distinct(), f"{ENTITIES} SELECT DISTINCT type FROM e")
add("related_entities", lambda t: ontology.related_entities(_relations(t), _entities(t), t.part.where("p_size = 7").select(F.concat(F.lit("e"), "p_partkey").alias("id")), "blocks"), f"{RELATIONS} SELECT from_id, rel, to_id, {_pick_sql(_TYPES)} AS type FROM r JOIN part p ON to_id = 'e' || p.p_partkey WHERE rel = 'blocks' AND from_id IN (SELECT 'e' || p_partkey FROM part WHERE p_size = 7)")
add("schema_overlay", lambda t: ontology.schema_overlay(t.nation.select("n_regionkey", "n_name"), t.region.where("r_regionkey > 2").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name")), "n_regionkey"), "SELECT n_regionkey, n_name FROM nation WHERE n_regionkey <= 2 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 2")


def _chainlinks(t: Tables) -> tuple[DataFrame, DataFrame]:
    note = lambda c: F.col(c).cast("string")
    links = t.orders.select(note("o_custkey").alias("from_id"), (F.col("o_custkey") + F.lit(1)).cast("string").alias("to_id")).distinct().where(F.col("from_id").cast("long") % 10 < 8)
    new = t.customer.select((F.col("c_custkey") + 3).cast("string").alias("from_id"), note("c_custkey").alias("to_id"))
    return links, new


add("acyclic_check", lambda t: ontology.acyclic_check(*_chainlinks(t)), "WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS a, o_custkey + 1 AS b FROM orders WHERE o_custkey % 10 < 8), w AS (SELECT c_custkey + 3 AS f, c_custkey AS t, c_custkey AS node, 0 AS d FROM customer UNION ALL SELECT f, t, b, d + 1 FROM w JOIN l ON a = node WHERE d < 5 AND node <> f) SELECT DISTINCT CAST(f AS VARCHAR) AS from_id, CAST(t AS VARCHAR) AS to_id FROM w WHERE node = f")

# synthesis
_SRC = f"{RANKED}, src AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, r.note_id) AS rank, r.note_id, n.tier, n.content_raw FROM ranked r JOIN notes n ON n.note_id = r.note_id WHERE n.tier IN ('A', 'B'))"


def _sources(t: Tables) -> DataFrame:
    ranked = cut(_ranked(t))
    return synthesis.synthesis_sources(ranked, ranked, t.notes)


add("synthesis_sources", _sources, f"{_SRC} SELECT query_id, rank, note_id FROM src")
add("synthesis_context", lambda t: synthesis.synthesis_context(_sources(t), t.notes), f"{_SRC}, c AS (SELECT query_id, string_agg('--- NOTE: ' || note_id || ' (Tier ' || tier || ') ---' || chr(10) || substr(content_raw, 1, 500), chr(10) ORDER BY rank) AS context FROM src GROUP BY 1) SELECT query_id, context, CAST(floor(length(context) / 4) AS BIGINT) AS tokens FROM c")
_RAW = ('```json\n{"answer": "yes", "confidence": 0.9}\n```', 'Sure: {"answer": "maybe", "confidence": 0.2} ok', "nothing", "{broken")


def _answered(t: Tables) -> DataFrame:
    return t.questions.select("query_id", "text", _pick(_RAW, "query_id").alias("raw"))


add("extract_json", lambda t: _answered(t).select("query_id", synthesis.extract_json(F.col("raw")).alias("json")), """SELECT c_custkey AS query_id, list_extract(['{"answer": "yes", "confidence": 0.9}', '{"answer": "maybe", "confidence": 0.2}', NULL, NULL], CAST(c_custkey % 4 + 1 AS INT)) AS json FROM customer""")
_RES = f"{_SRC}, res AS (SELECT q.query_id, coalesce(list_extract(['yes', 'maybe', NULL, NULL], CAST(q.query_id % 4 + 1 AS INT)), 'No specific answer found for: ' || substr(text, 1, 50) || '...') AS answer, list_extract([0.9, 0.2, 0.0, 0.0], CAST(q.query_id % 4 + 1 AS INT)) AS confidence, coalesce(n, 0) AS n_sources FROM questions q LEFT JOIN (SELECT query_id, count(*) AS n FROM src WHERE rank <= 10 GROUP BY 1) s USING (query_id))"


def _result(t: Tables) -> DataFrame:
    return synthesis.synthesis_result(_answered(t), _sources(t), t.notes)


add("synthesis_result", _result, f"{_RES} SELECT * FROM res")
add("validate_synthesis", lambda t: synthesis.validate_synthesis(_result(t)), f"{_RES} SELECT query_id, array_to_string(list_filter([CASE WHEN confidence < 0.3 THEN 'confidence below threshold' END, CASE WHEN n_sources < 1 THEN 'sources count below minimum' END], lambda x: x IS NOT NULL), '; ') AS errors, confidence >= 0.3 AND n_sources >= 1 AS valid FROM res")
add("quality_score", lambda t: synthesis.quality_score(_result(t)), f"{_RES}, s AS (SELECT query_id, 0.4 * least(1.0, confidence / 0.7) + 0.3 * least(1.0, n_sources / 5) + 0.3 AS sc FROM res) SELECT query_id, round(sc, 3) AS score, CASE WHEN sc >= 0.8 THEN 'EXCELLENT' WHEN sc >= 0.5 THEN 'GOOD' ELSE 'NEEDS_WORK' END AS quality FROM s")

# tables
add("upsert_notes", lambda t: tables.upsert(t.notes, t.notes.where("tier = 'A'").withColumn("created_at", F.expr("created_at + INTERVAL 1 DAY")).withColumn("domain", F.lit("new")), "note_id", "created_at").select("note_id", "domain", "created_at"), f"{NOTES} SELECT note_id, CASE WHEN tier = 'A' THEN 'new' ELSE domain END AS domain, CASE WHEN tier = 'A' THEN created_at + INTERVAL 1 DAY ELSE created_at END AS created_at FROM notes")
add("delete_notes", lambda t: tables.delete(t.notes, t.notes.where("domain = 'cti'"), "note_id").select("note_id"), f"{NOTES} SELECT note_id FROM notes WHERE domain <> 'cti'")
add("notes_by_id", lambda t: t.notes.join(t.customer.select(F.concat(F.lit("note_"), "c_custkey").alias("note_id")), "note_id", "left_semi").select("note_id", "source_ref"), f"{NOTES} SELECT note_id, source_ref FROM notes WHERE note_id IN (SELECT 'note_' || c_custkey FROM customer)")
add("notes_by_source_ref", lambda t: t.notes.join(t.customer.select(F.concat(F.lit("src:"), "c_custkey").alias("source_ref")), "source_ref", "left_semi").select("note_id", "source_ref"), f"{NOTES} SELECT note_id, source_ref FROM notes WHERE source_ref IN (SELECT 'src:' || c_custkey FROM customer)")
add("notes_by_domain", lambda t: t.notes.where("domain = 'cti'").select("note_id"), f"{NOTES} SELECT note_id FROM notes WHERE domain = 'cti'")
add("count_notes", lambda t: t.notes.agg(F.count("*").alias("n")), f"{NOTES} SELECT count(*) AS n FROM notes")
add("notes_per_domain", lambda t: t.notes.groupBy("domain").agg(F.count("*").alias("n")), f"{NOTES} SELECT domain, count(*) AS n FROM notes GROUP BY 1")
add("storage_stats", lambda t: tables.sizes({"notes": t.notes, "edges": t.kg_edges, "events": t.events}), f"{with_tables('notes', 'kg_edges')} SELECT 'notes' AS name, count(*) AS n FROM notes UNION ALL SELECT 'edges', count(*) FROM kg_edges UNION ALL SELECT 'events', count(*) FROM events")
add("reindex_vectors", lambda t: tables.replace_column(t.embeddings.select("vec_id", "label"), t.embeddings.where("vec_id % 7 = 0").select("vec_id", (F.col("label") + 100).alias("label")), "vec_id", "label"), "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
