"""Queries on extraction, note building and life cycle, and the entity index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import CASELESS, CODE_CONTEXT, KEYWORD_STOPWORDS, NAME_STOPWORDS, PATTERNS
from ..operators import extract, index, notes as build
from .derived import Tables, with_tables
from ..operators.retrieve import embed_batch
from .registry import add

NOTES = with_tables("notes")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_sql(kind: str, source: str = "notes", key: str = "note_id", text: str = "content_raw") -> str:
    """SELECT of (key, entity_value) of one type."""
    group = 1 if kind == "person" else 0
    options = "'i'" if kind in CASELESS else "'c'"
    sql = f"SELECT DISTINCT {key}, replace(lower(v), ' ', '-') AS entity_value FROM (SELECT {key}, {text}, unnest(regexp_extract_all({text}, {quoted(PATTERNS[kind])}, {group}, {options})) AS v FROM {source}) x"
    if kind == "person":
        sql += f" WHERE lower(v) NOT IN ({', '.join(map(quoted, NAME_STOPWORDS))})"
    if kind in ("md5", "sha1", "sha256"):
        lines = f"SELECT {key} AS k, unnest(string_split_regex({text}, '\\r\\n|\\n|\\r')) AS line FROM {source}"
        code = f"SELECT k, lower(unnest(regexp_extract_all(line, '\\b[a-fA-F0-9]{{32,64}}\\b'))) AS h FROM ({lines}) l WHERE regexp_matches(line, {quoted(CODE_CONTEXT)}, 'i')"
        sql += f" WHERE ({key}, lower(v)) NOT IN ({code})"
    return sql


for _kind in PATTERNS:
    add(f"extract_{_kind}", lambda t, kind=_kind: extract.extract_type(t.notes, kind), f"{NOTES} {values_sql(_kind)}")

# indicators that occur in documents
for _kind in ("ipv4", "email", "sha1"):
    add(f"extract_{_kind}_documents", lambda t, kind=_kind: extract.extract_type(t.documents, kind, "text", "doc_id"), values_sql(_kind, "documents", "doc_id", "text"))

KINDS = tuple(PATTERNS)
ALL_SQL = " UNION ALL ".join(f"SELECT note_id, '{k}' AS entity_type, entity_value FROM ({values_sql(k)}) e" for k in KINDS)
#: Tables of notes and their entities.
INDEX = f"{NOTES}, entity_index AS (SELECT DISTINCT entity_type, entity_value, note_id FROM ({ALL_SQL}) a)"


def entity_index(t: Tables) -> DataFrame:
    return index.build_entity_index(extract.extract_all_long(t.notes))


add("extract_all_long", lambda t: extract.extract_all_long(t.notes), f"{NOTES} {ALL_SQL}")
add("filter_code_hashes", lambda t: t.documents.select("doc_id", F.explode(extract.code_hashes(F.col("text"))).alias("hash")),
    f"SELECT DISTINCT doc_id, lower(h) AS hash FROM (SELECT doc_id, unnest(regexp_extract_all(line, '\\b[a-fA-F0-9]{{32,64}}\\b')) AS h FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents) l WHERE regexp_matches(line, {quoted(CODE_CONTEXT)}, 'i')) x")


def _ner(t: Tables) -> DataFrame:
    made = t.notes.select("note_id", F.format_string('{"person": [" Ana %s ", "x"], "location": ["Paris"], "event": [], "temporal": ["%s"]}', F.col("importance"), F.col("domain")).alias("json"))
    return extract.merge_ner(extract.extract_all_long(t.notes, kinds=("actor", "tool")), made)


add("merge_ner", _ner, f"""{NOTES}, base AS (SELECT note_id, 'actor' AS entity_type, entity_value FROM ({values_sql('actor')}) a UNION ALL SELECT note_id, 'tool', entity_value FROM ({values_sql('tool')}) b)
SELECT DISTINCT * FROM (SELECT * FROM base UNION ALL SELECT note_id, 'person', 'ana ' || importance FROM notes UNION ALL SELECT note_id, 'location', 'paris' FROM notes UNION ALL SELECT note_id, 'temporal', domain FROM notes) u""")


def _alias_rows(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("Fancy-Bear", "pawn storm", "COZY BEAR", "Sandworm", "apt28")]), (F.col("importance") % 5 + 1).cast("int"))
    return t.notes.select("note_id", F.when(F.col("domain") == "cti", "actor").otherwise("tool").alias("entity_type"), name.alias("entity_value"))


ALIAS_ROWS = f"{NOTES}, rows_ AS (SELECT note_id, CASE WHEN domain = 'cti' THEN 'actor' ELSE 'tool' END AS entity_type, list_extract(['Fancy-Bear', 'pawn storm', 'COZY BEAR', 'Sandworm', 'apt28'], CAST(importance % 5 + 1 AS INT)) AS entity_value FROM notes), aliases AS (SELECT * FROM (VALUES ('actor', 'fancy bear', 'apt28'), ('actor', 'pawn storm', 'apt28'), ('actor', 'cozy bear', 'apt29')) v(entity_type, alias, canonical))"
add("resolve_alias", lambda t: extract.resolve_alias(_alias_rows(t)), f"{ALIAS_ROWS} SELECT r.note_id, r.entity_type, r.entity_value, coalesce(a.canonical, lower(r.entity_value)) AS canonical FROM rows_ r LEFT JOIN aliases a ON a.entity_type = r.entity_type AND a.alias = replace(lower(r.entity_value), '-', ' ')")


def _overlay(t: Tables) -> DataFrame:
    builtin = t.nation.select(F.concat(F.lit("type"), F.col("n_regionkey")).alias("entity_type"), F.lower("n_name").alias("alias"), F.col("n_name").alias("canonical"))
    user = t.region.where("r_regionkey < 2").select(F.concat(F.lit("type"), F.col("r_regionkey")).alias("entity_type"), F.lower("r_name").alias("alias"), F.col("r_name").alias("canonical"))
    return extract.alias_overlay(builtin, user)


add("alias_overlay", _overlay, "SELECT 'type' || n_regionkey AS entity_type, lower(n_name) AS alias, n_name AS canonical FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2) UNION ALL SELECT 'type' || r_regionkey, lower(r_name), r_name FROM region WHERE r_regionkey < 2")


def _alias_pairs(t: Tables) -> DataFrame:
    aliases = t.spark.createDataFrame([("fancy bear", "apt28"), ("pawn storm", "apt28"), ("cozy bear", "apt29")], "alias string, canonical string")
    pick = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("Fancy Bear", "apt28", "Pawn Storm", "cozy bear", "APT2")]), (F.col(c) % 5 + 1).cast("int"))
    return extract.alias_match(t.orders.select("o_orderkey", pick("o_orderkey").alias("predicted"), pick("o_custkey").alias("expected")), aliases)


add("alias_match", _alias_pairs, """WITH names AS (SELECT * FROM (VALUES ('fancy bear', 'apt28'), ('pawn storm', 'apt28'), ('cozy bear', 'apt29'), ('apt28', 'apt28'), ('apt29', 'apt29')) v(a, c)),
p AS (SELECT o_orderkey, list_extract(['Fancy Bear', 'apt28', 'Pawn Storm', 'cozy bear', 'APT2'], CAST(o_orderkey % 5 + 1 AS INT)) AS predicted, list_extract(['Fancy Bear', 'apt28', 'Pawn Storm', 'cozy bear', 'APT2'], CAST(o_custkey % 5 + 1 AS INT)) AS expected FROM orders)
SELECT o_orderkey, predicted, expected, lower(predicted) = lower(expected) OR contains(lower(predicted), lower(expected)) OR contains(lower(expected), lower(predicted)) OR coalesce(x.c = y.c, false) AS same_actor
FROM p LEFT JOIN names x ON x.a = lower(predicted) LEFT JOIN names y ON y.a = lower(expected)""")
add("infer_entity_type", lambda t: t.questions.select("query_id", extract.infer_entity_type(F.col("text")).alias("entity_type")).union(t.part.select(F.col("p_partkey"), extract.infer_entity_type(F.col("p_name"), F.when(F.col("p_size") == 1, "event")))),
    f"""{with_tables('questions')}, v AS (SELECT query_id, lower(text) AS x, NULL AS hint FROM questions UNION ALL SELECT p_partkey, lower(p_name), CASE WHEN p_size = 1 THEN 'event' END FROM part)
SELECT query_id, CASE WHEN hint IS NOT NULL THEN hint WHEN contains(x, 'cve-') THEN 'cve' WHEN regexp_matches(x, '\\b(apt|unc|ta|fin)\\d+\\b|lazarus|sandworm|fancy bear|cozy bear|volt typhoon') THEN 'intrusion_set'
WHEN regexp_matches(x, 'north korea|(russian|iranian|chinese) threat actor') THEN 'threat_actor' WHEN regexp_matches(x, 'cobalt strike|metasploit|mimikatz|bloodhound|dropbear|empire') THEN 'tool' WHEN regexp_matches(x, 'operation|campaign') THEN 'campaign' ELSE 'entity' END AS entity_type FROM v""")  # fmt: skip
add("technique_parent", lambda t: extract.technique_parent(t.notes), f"{NOTES} SELECT DISTINCT note_id, split_part(v, '.', 1) AS technique FROM (SELECT note_id, unnest(regexp_extract_all(content_raw, 'T\\d{{4}}(?:\\.\\d{{3}})?')) AS v FROM notes) x")
_ACTORS = ", ".join(f"nullif(regexp_extract(content_raw, {quoted(p)}), '')" for p in (*(f"(?i){p}" for p in extract.ACTOR_PATTERNS), extract.ACTOR_PHRASE))
add("primary_actor", lambda t: extract.primary_actor(t.notes), f"{NOTES} SELECT note_id, coalesce({_ACTORS}, '') AS primary_actor FROM notes")
IOCS = " UNION ALL ".join(f"SELECT note_id, '{k}' AS entity_type, entity_value FROM ({values_sql(k)}) e" for k in ("ipv4", "domain", "url", "md5", "sha1", "sha256", "email"))
add("hunt_iocs", lambda t: extract.hunt_iocs(t.notes, t.region.select(F.concat(F.lit("evil"), F.col("r_regionkey"), F.lit(".example.com")).alias("domain"))),
    f"{NOTES} SELECT * FROM ({IOCS}) i WHERE entity_value NOT IN (SELECT 'evil' || r_regionkey || '.example.com' FROM region)")

# building and life cycle
CONTEXT = "CASE WHEN length(trim(split_part({0}, '.', 1))) > 150 THEN substr(trim(split_part({0}, '.', 1)), 1, 150) || '...' ELSE trim(split_part({0}, '.', 1)) END"
STOP = ", ".join(map(quoted, KEYWORD_STOPWORDS))
WORDS = "SELECT {0}, keyword, count(*) AS n, min(pos) AS first FROM (SELECT {0}, unnest(w) AS keyword, generate_subscripts(w, 1) AS pos FROM (SELECT {0}, regexp_extract_all(lower({1}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {2}) a) b WHERE regexp_full_match(keyword, '[a-z]{{4,}}') AND keyword NOT IN (" + STOP + ") GROUP BY ALL"
add("context_sentence", lambda t: t.documents.select("doc_id", build.context_sentence(F.col("text")).alias("context")), f"SELECT doc_id, {CONTEXT.format('text')} AS context FROM documents")
add("keywords_topk", lambda t: build.keywords_topk(t.documents, 10, "doc_id", "text"), f"SELECT doc_id, rank, keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM ({WORDS.format('doc_id', 'text', 'documents')}) k) r WHERE rank <= 10")
BUILT = f"{NOTES}, words AS ({WORDS.format('note_id', 'content_raw', 'notes')}), top AS (SELECT note_id, list(keyword ORDER BY n DESC, first) AS ks FROM words GROUP BY note_id), built AS (SELECT n.*, {CONTEXT.format('content_raw')} AS context, coalesce(array_to_string(ks[1:7], ','), '') AS keywords FROM notes n LEFT JOIN top USING (note_id))"
HASH = "substr(sha256(content_raw || context || replace(keywords, ',', '') || domain), 1, 16)"
add("construct_notes", lambda t: build.construct_notes(t.notes).select("note_id", "context", F.array_join("keywords", ",").alias("keywords"), F.array_join("tags", ",").alias("tags"), "tier", "input_hash"), f"{BUILT} SELECT note_id, context, keywords, domain AS tags, 'A' AS tier, {HASH} AS input_hash FROM built")
add("embedded_notes", lambda t: build.construct_notes(t.notes, embed_batch).select("note_id", "context", F.array_join("keywords", ",").alias("keywords"), F.array_join("tags", ",").alias("tags"), "tier", "input_hash", F.size("vector").alias("dim"), F.exists("vector", lambda x: x != 0).alias("embedded")), f"{BUILT} SELECT note_id, context, keywords, domain AS tags, 'A' AS tier, {HASH} AS input_hash, 64 AS dim, content_raw IS NOT NULL AS embedded FROM built")
add("input_hash", lambda t: build.construct_notes(t.notes).select("note_id", "input_hash"), f"{BUILT} SELECT note_id, {HASH} AS input_hash FROM built")
add("note_id", lambda t: t.notes.select(F.col("note_id").alias("old_id"), build.note_id(F.col("content_raw"), F.col("source_ref")).alias("note_id")), f"{NOTES} SELECT note_id AS old_id, 'note_' || substr(sha256(source_ref || chr(31) || content_raw), 1, 16) AS note_id FROM notes")
add("governance_validate", lambda t: build.governance_validate(t.documents.withColumnRenamed("text", "content_raw"), 5000).select("doc_id", "violation"), "SELECT doc_id, CASE WHEN text IS NULL THEN 'GOV-011' WHEN length(text) > 5000 THEN 'LIMIT' END AS violation FROM documents")
add("infer_persistence", lambda t: t.notes.select("note_id", build.infer_persistence(F.col("source_type"), F.col("domain")).alias("persistence")), f"{NOTES} SELECT note_id, CASE WHEN source_type IN ('ingestion', 'report') AND domain = 'cti' THEN 'knowledge' WHEN source_type = 'synthesis' THEN 'wisdom' WHEN source_type = 'task_output' AND domain <> 'cti' THEN 'intelligence' ELSE 'memory' END AS persistence FROM notes")
AS_OF = "1998-06-01"
add("expire_filter", lambda t: build.expire_filter(t.notes.withColumn("ttl_anchor", F.when(F.col("importance") == 3, F.lit("1995-01-01").cast("timestamp"))).withColumn("updated_at", F.when(F.col("importance") == 7, F.lit("1998-07-30").cast("timestamp"))), AS_OF).select("note_id", "persistence"), f"{NOTES} SELECT note_id, persistence FROM notes WHERE persistence = 'knowledge' OR date_diff('day', CASE importance WHEN 3 THEN DATE '1995-01-01' WHEN 7 THEN greatest(CAST(created_at AS DATE), DATE '1998-07-30') ELSE CAST(created_at AS DATE) END, DATE '{AS_OF}') <= CASE persistence WHEN 'memory' THEN 30 WHEN 'wisdom' THEN 90 ELSE 7 END")
add("review_flag", lambda t: t.notes.select("note_id", build.review_flag(F.col("confidence"), F.col("evolution_count")).alias("review")), f"{NOTES} SELECT note_id, confidence < 0.5 OR evolution_count > 5 AS review FROM notes")
add("track_access", lambda t: build.track_access(t.notes, t.telemetry.select("note_id", "ts")), f"{with_tables('notes', 'telemetry')} SELECT n.note_id, count(t.event_id) AS access_count, max(ts) AS last_accessed FROM notes n LEFT JOIN telemetry t ON t.note_id = n.note_id GROUP BY n.note_id")
add("bump_evolution", lambda t: build.bump_evolution(t.notes).select("note_id", "evolution_count", "confidence"), f"{NOTES} SELECT note_id, evolution_count + 1 AS evolution_count, least(confidence, 0.95) AS confidence FROM notes")
add("valid_embedding", lambda t: t.embeddings.select("vec_id", build.valid_embedding(F.col("embedding"), 64).alias("valid")), "SELECT vec_id, len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0 AND list_var_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) >= 0.001 AS valid FROM embeddings")
add("dedupe_content", lambda t: build.dedupe_content(t.documents, text="text", order="doc_id").select("doc_id", "content_hash"), "SELECT min(doc_id) AS doc_id, substr(sha256(text), 1, 32) AS content_hash FROM documents GROUP BY 2")
add("dedupe_source_ref", lambda t: build.dedupe_source_ref(t.notes, t.notes.where("domain = 'cti'")).select("note_id", "source_ref"), f"{NOTES} SELECT note_id, source_ref FROM notes WHERE source_ref NOT IN (SELECT source_ref FROM notes WHERE domain = 'cti')")
# a row per sentence taken: the chunk it is in, and what that chunk holds by then
_PACKED = """WITH RECURSIVE s AS (SELECT doc_id, {split} AS ss FROM documents WHERE {where}),
f AS (SELECT doc_id, 0 AS k, 0 AS i, '' AS cur FROM s
  UNION ALL SELECT doc_id, k + 1, i + CAST(past AS INT), CASE WHEN past THEN {carried} ELSE joined END
  FROM (SELECT *, length(joined) > {size} AND cur <> '' AS past FROM (SELECT f.*, ss[k + 1] AS next, CASE WHEN cur = '' THEN ss[k + 1] ELSE cur || '{glue}' || ss[k + 1] END AS joined FROM f JOIN s USING (doc_id) WHERE k < len(ss)) j) p),
c AS (SELECT doc_id, i, arg_max(cur, k) AS chunk FROM f GROUP BY ALL)"""


def _sentences_sql(size: int, overlap: int, least: int) -> str:
    """Sentences end where blanks follow a full stop, a question or an exclamation mark."""
    split = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    carried = f"right(cur, {overlap}) || ' ' || next" if overlap else "next"
    packed = _PACKED.format(split=split, where="text IS NOT NULL", carried=carried, size=size, glue=" ")
    return f"{packed} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, chunk FROM c WHERE length(chunk) > {least}"


add("chunk_report", lambda t: build.chunk_report(t.documents, 3000, "text", "doc_id"), _PACKED.format(split="string_split(text, '. ')", where="length(text) > 3000", carried="next", size=3000, glue=". ")
    + " SELECT doc_id, doc_id || ':chunk:' || i AS chunk_ref, chunk FROM c UNION ALL SELECT doc_id, doc_id || ':chunk:0', text FROM documents WHERE coalesce(length(text), 0) <= 3000")
add("chunk_overlap", lambda t: build.chunk_sentences(t.documents, "doc_id", "text", 2048, 512, 50), _sentences_sql(2048, 512, 50))
add("chunk_sentences_800", lambda t: build.chunk_sentences(t.documents, "doc_id", "text", 800, 0, 20), _sentences_sql(800, 0, 20))
add("session_notes", lambda t: build.session_notes(t.conversations.withColumn("date", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("day "), "turn")))), "SELECT conv_id, substr('Conversation session ' || conv_id || CASE WHEN conv_id % 2 = 0 THEN ' (day ' || min(turn) || ')' ELSE '' END || ':' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn), 1, 4000) AS content FROM conversations GROUP BY conv_id")
add("recent_notes", lambda t: build.recent_notes(t.notes, 25).select("note_id", "created_at"), f"{NOTES} SELECT note_id, created_at FROM notes ORDER BY created_at DESC, note_id LIMIT 25")
add("pii_detect", lambda t: build.pii_detect(t.documents, "doc_id", "text"))
_PII = "|".join(p for _, p, _, i in build.PII if not i)
add("pii_redact", lambda t: build.pii_apply(t.documents, "doc_id", "text"), f"SELECT doc_id, regexp_replace(text, {quoted(_PII)}, '[REDACTED]', 'g') AS content FROM documents")
add("pii_block", lambda t: build.pii_apply(t.documents, "doc_id", "text", "block").select("doc_id"), f"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, {quoted(_PII)})")

# entity index
KEYED = "SELECT query_id, lower(entity_value) AS entity_value FROM ("
ASK = f"SELECT query_id, entity_type, entity_value FROM (SELECT query_id, 'cve' AS entity_type, entity_value FROM ({values_sql('cve', 'questions', 'query_id', 'text')}) a UNION ALL SELECT query_id, 'tool', entity_value FROM ({values_sql('tool', 'questions', 'query_id', 'text')}) b UNION ALL SELECT query_id, 'intrusion_set', entity_value FROM ({values_sql('intrusion_set', 'questions', 'query_id', 'text')}) c) q"
ASKED = f"{with_tables('notes', 'questions')}, entity_index AS (SELECT DISTINCT entity_type, entity_value, note_id FROM ({ALL_SQL}) a), asked AS ({ASK})"


#: Types of entities that are taken from questions.
ASKED_KINDS = ("cve", "tool", "intrusion_set")


def asked(t: Tables) -> DataFrame:
    """(query_id, entity_type, entity_value) of the questions' entities."""
    return extract.extract_all_long(t.questions, "text", "query_id", ASKED_KINDS)


def asked_index(t: Tables) -> DataFrame:
    """The postings that questions can ask for: other types meet no question, so they aren't searched for."""
    return index.build_entity_index(extract.extract_all_long(t.notes, kinds=ASKED_KINDS))


def _ranked(where: str, k: int, order: str = "created_at DESC, note_id") -> str:
    return f"{ASKED} SELECT query_id, rank, note_id FROM (SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM (SELECT DISTINCT a.query_id, i.note_id, n.created_at FROM asked a JOIN entity_index i USING (entity_type, entity_value) JOIN notes n ON n.note_id = i.note_id WHERE {where}) h) r WHERE rank <= {k}"


add("build_entity_index", entity_index, f"{INDEX} SELECT * FROM entity_index")
add("index_remove_notes", lambda t: index.index_remove_notes(entity_index(t), t.notes.where("tier = 'C'")), f"{INDEX} SELECT * FROM entity_index WHERE note_id NOT IN (SELECT note_id FROM notes WHERE tier = 'C')")
add("recall_entity", lambda t: index.recall_entity(entity_index(t), asked(t), t.notes, 10), _ranked("true", 10))
add("recall_cve", lambda t: index.recall_typed(entity_index(t), asked(t).where("entity_type = 'cve'").drop("entity_type"), t.notes, "cve", 5), _ranked("a.entity_type = 'cve'", 5))
add("recall_tool", lambda t: index.recall_typed(entity_index(t), asked(t).where("entity_type = 'tool'").drop("entity_type"), t.notes, "tool", 5), _ranked("a.entity_type = 'tool'", 5))


def _techniques(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("T"), (F.col("p_partkey") % 90 + 1000)).alias("entity_value"))


add("recall_technique", lambda t: index.recall_typed(entity_index(t), _techniques(t), t.notes, "attack_pattern", 25),
    f"{INDEX} SELECT query_id, rank, note_id FROM (SELECT p_partkey AS query_id, i.note_id, row_number() OVER (PARTITION BY p_partkey ORDER BY created_at DESC, i.note_id) AS rank FROM part JOIN entity_index i ON i.entity_type = 'attack_pattern' AND i.entity_value = 't' || (p_partkey % 90 + 1000) JOIN notes n ON n.note_id = i.note_id) r WHERE rank <= 25")
add("recall_actor", lambda t: index.recall_actor(entity_index(t), asked(t).where("entity_type = 'intrusion_set'").select("query_id", "entity_value"), t.notes, 10), _ranked("a.entity_type = 'intrusion_set'", 10))
add("search_entities_prefix", lambda t: index.search_entities_prefix(entity_index(t), t.region.select(F.element_at(F.array(*[F.lit(x) for x in ("apt", "CVE-2024-01", "10.2", "t10", "m")]), F.col("r_regionkey") + 1).alias("prefix")), 10),
    f"{INDEX}, p AS (SELECT list_extract(['apt', 'CVE-2024-01', '10.2', 't10', 'm'], r_regionkey + 1) AS prefix FROM region) SELECT prefix, entity_type, entity_value, n FROM (SELECT *, row_number() OVER (PARTITION BY prefix, entity_type ORDER BY entity_value) AS k FROM p JOIN (SELECT entity_type, entity_value, count(DISTINCT note_id) AS n FROM entity_index GROUP BY ALL) v ON starts_with(entity_value, lower(prefix))) r WHERE k <= 10")
add("entity_stats", lambda t: index.entity_stats(entity_index(t)), f"{INDEX} SELECT entity_type, count(DISTINCT entity_value) AS unique_entities, count(*) AS mappings FROM entity_index GROUP BY 1")
add("entity_listing", lambda t: index.entity_listing(entity_index(t), None, "1", 20, 50),
    f"{INDEX}, c AS (SELECT entity_type, entity_value, count(DISTINCT note_id) AS note_count FROM entity_index WHERE contains(entity_value, '1') GROUP BY ALL) SELECT *, (SELECT count(*) FROM c) AS total FROM c ORDER BY note_count DESC, entity_type, entity_value LIMIT 50 OFFSET 20")
