"""Queries on retrieval, evolution and consolidation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut
from ..functions.rules import INTENT_KEYWORDS, PATTERNS, POLICIES
from ..operators import evolve, extract, fusion, graph, index, retrieve
from .derived import Tables, with_tables

from .notes import ASKED, INDEX, NOTES, asked, asked_index, entity_index, quoted
from .registry import add, add_alias

COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9)"


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every 50th vector as a query, against all."""
    v = t.embeddings.select("vec_id", "embedding")
    return v.where("vec_id % 50 = 0"), v


def _topk_sql(score: str, k: int, where: str = "true") -> str:
    return f"SELECT query_id, rank, note_id, score FROM (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(v.vec_id AS VARCHAR) AS note_id, {score} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, CAST(v.vec_id AS VARCHAR)) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {where}) r WHERE rank <= {k}"


_PAIRS = f"SELECT q.vec_id AS query_id, v.vec_id AS note_id, {COS.replace('9)', '6)')} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0"
add("cosine_similarity", lambda t: retrieve.cosine_pairs(*_vectors(t)).withColumn("score", F.round("score", 6)), _PAIRS)
add_alias("cosine_similarity_all", "cosine_similarity")
add("vector_topk", lambda t: retrieve.vector_topk(*_vectors(t), 10, 0.15), _topk_sql(COS, 10, f"{COS} >= 0.15"))
add("naive_vector_topk", lambda t: retrieve.vector_topk(*_vectors(t), 5, None), _topk_sql(COS, 5))
_L2 = "round(1 - sqrt(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) ** 2))), 9)"
add("vector_topk_l2", lambda t: retrieve.vector_topk_l2(_vectors(t)[0], t.embeddings.select("vec_id", "embedding", "label"), 10, "label"), _topk_sql(_L2, 10))
add("vector_topk_lsh", lambda t: retrieve.vector_topk_lsh(*_vectors(t), 10))
add("memory_search", lambda t: retrieve.memory_search(_vectors(t)[0], t.embeddings.select("vec_id", "embedding", F.col("label").cast("string").alias("source"), (F.col("vec_id") % 2).cast("string").alias("session_key")), "3", 5, "1"), _topk_sql(COS, 5, "v.label = 3 AND v.vec_id % 2 = 1"))
add("memory_recent", lambda t: t.conversations.orderBy(F.desc("conv_id"), F.desc("turn")).limit(20).select("conv_id", "turn", "role"), "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 20")
add("memory_stats", lambda t: t.documents.groupBy("source").agg(F.count("*").alias("n")), "SELECT source, count(*) AS n FROM documents GROUP BY 1")
add("memory_delete", lambda t: t.documents.join(t.documents.where("lang = 'fr'").select(F.sha2("text", 256).alias("h")), F.sha2("text", 256) == F.col("h"), "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')")
add("embed_batch", lambda t: retrieve.embed_batch(t.documents, "doc_id", "text"))


def _repair(t: Tables) -> DataFrame:
    broken = retrieve.embed_batch(t.documents, "doc_id", "text").join(t.documents.select("doc_id", "text"), "doc_id").withColumn("vector", F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<float>")).otherwise(F.col("vector")))
    return retrieve.repair_embeddings(broken, "doc_id", "text", "vector", F.size("vector") == 64)


add("repair_embeddings", _repair)

# candidates: a question's notes by entity, scored by age; and by graph
SCORED = f"{ASKED}, hits AS (SELECT DISTINCT query_id, note_id FROM asked JOIN entity_index USING (entity_type, entity_value)), vec AS (SELECT query_id, note_id, 1 + CAST(substr(note_id, 6) AS BIGINT) % 97 AS score FROM hits), gr AS (SELECT query_id, note_id, 1 + CAST(substr(note_id, 6) AS BIGINT) % 13 AS score FROM hits WHERE CAST(substr(note_id, 6) AS BIGINT) % 2 = 0)"


def _hits(t: Tables) -> DataFrame:
    return asked(t).join(asked_index(t), ["entity_type", "entity_value"]).select("query_id", "note_id").distinct()


def _scored(t: Tables, mod: int, even: bool = False) -> DataFrame:
    number = F.substring("note_id", 6, 20).cast("long")
    rows = _hits(t).select("query_id", "note_id", (1 + number % mod).alias("score"), number.alias("number"))
    return (rows.where("number % 2 = 0") if even else rows).drop("number")


def _postings(t: Tables) -> DataFrame:
    """The index with a note's two scores, the second for even numbers only."""
    number = F.substring("note_id", 6, 20).cast("long")
    return asked_index(t).select("entity_type", "entity_value", "note_id", (1 + number % 97).alias("vs"), F.when(number % 2 == 0, 1 + number % 13).alias("gs"))


def _per_text(plan: Callable[[Tables], DataFrame], every: bool = False) -> Callable[[Tables], DataFrame]:
    """``plan``, whose rows carry a query_id, with questions of equal text answered once.

    ``every``: answers have all notes of an entity, so those of a text that many ask for are given out by many tasks.
    """

    def run(t: Tables) -> DataFrame:
        texts = t.questions.groupBy("text").agg(F.min("query_id").alias("asked_id"))
        answers = plan(t.with_table("questions", texts.select(F.col("asked_id").alias("query_id"), "text")))
        askers = t.questions.join(texts, "text").select("query_id", "asked_id")
        named = answers.withColumnRenamed("query_id", "asked_id")
        return (fusion.give_out(named, askers, "asked_id") if every else named.join(askers, "asked_id")).select(*answers.columns)

    return run


def _weights(t: Tables) -> DataFrame:
    return retrieve.traversal_policy(t.questions.select("query_id", retrieve.classify_intent(F.col("text"))["intent"].alias("intent")))


_LOW = "lower(text)"
INTENT_SCORES = ", ".join("(" + " + ".join(f"CAST(contains({_LOW}, {quoted(w)}) AS INT)" for w in ws) + f") AS s_{n}" for n, ws in INTENT_KEYWORDS.items())
_NAMES = list(INTENT_KEYWORDS)
_BEST = "greatest(" + ", ".join(f"s_{n}" for n in _NAMES) + ")"
_FOUND = " + ".join(f"CAST(s_{n} > 0 AS INT)" for n in _NAMES)
_FIRST = "CASE " + " ".join(f"WHEN s_{n} = {_BEST} THEN '{n}'" for n in _NAMES) + " END"
INTENTS = f"kw AS (SELECT query_id, text, {INTENT_SCORES} FROM questions), intents AS (SELECT query_id, text, CASE WHEN {_BEST} >= 2 OR ({_BEST} = 1 AND {_FOUND} = 1) THEN {_FIRST} ELSE 'exploratory' END AS intent, CASE WHEN {_BEST} >= 2 THEN least(1.0, {_BEST} / 4) WHEN {_BEST} = 1 AND {_FOUND} = 1 THEN 0.6 ELSE 0.3 END AS confidence, CASE WHEN {_BEST} >= 2 THEN 'keyword' WHEN {_BEST} = 1 AND {_FOUND} = 1 THEN 'keyword_unambiguous' ELSE 'default' END AS method FROM kw)"
_POLICY = ", ".join(f"('{n}', {v}, {e}, {g}, {x}, {k})" for n, v, e, g, x, k in POLICIES)
POLICY = f"policies AS (SELECT * FROM (VALUES {_POLICY}) p(intent, vector, entity_index, graph, temporal, top_k))"
add("classify_intent", lambda t: t.questions.select("query_id", retrieve.classify_intent(F.col("text")).alias("c")).select("query_id", "c.intent", "c.confidence", "c.method"), f"{with_tables('questions')}, {INTENTS} SELECT query_id, intent, confidence, method FROM intents")
add("traversal_policy", lambda t: _weights(t), f"{with_tables('questions')}, {INTENTS}, {POLICY} SELECT query_id, intent, vector, entity_index, graph, temporal, top_k FROM intents JOIN policies USING (intent)")
_NORM = "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
add("minmax_normalize", _per_text(lambda t: retrieve.minmax_normalize(_scored(t, 97)).select("query_id", "note_id", F.round("score", 9).alias("score")), every=True), f"{SCORED} SELECT query_id, note_id, round({_NORM}, 9) AS score FROM vec WINDOW w AS (PARTITION BY query_id)")
_FUSED = f"v AS (SELECT query_id, note_id, {_NORM} AS vs FROM vec WINDOW w AS (PARTITION BY query_id)), g AS (SELECT query_id, note_id, {_NORM} AS gs FROM gr WINDOW w AS (PARTITION BY query_id)), fused AS (SELECT query_id, note_id, round(coalesce(vs * vector, 0) + coalesce(gs * graph, 0), 9) AS score FROM v FULL JOIN g USING (query_id, note_id) JOIN intents USING (query_id) JOIN policies USING (intent))"
add("blend_weighted", _per_text(lambda t: fusion.blend_weighted_postings(asked(t), _postings(t), _weights(t), 10)), f"{SCORED}, {INTENTS}, {POLICY}, {_FUSED} SELECT query_id, rank, note_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) AS rank FROM fused) r WHERE rank <= 10")
add("blend_rrf", _per_text(lambda t: fusion.blend_rrf_postings(asked(t), _postings(t), 10)), f"{SCORED}, ranks AS (SELECT query_id, note_id, 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id)) AS s FROM vec UNION ALL SELECT query_id, note_id, 1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id)) FROM gr), fused AS (SELECT query_id, note_id, round(sum(s), 9) AS score FROM ranks GROUP BY ALL) SELECT query_id, rank, note_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) AS rank FROM fused) r WHERE rank <= 10")
add("entity_boost", _per_text(lambda t: retrieve.entity_boost(_scored(t, 97), asked(t), entity_index(t), t.notes, 2.5, 1.5), every=True),
    f"{SCORED}, sh AS (SELECT v.query_id, v.note_id, count(*) AS n FROM vec v JOIN (SELECT DISTINCT query_id, entity_value FROM asked) a USING (query_id) JOIN (SELECT DISTINCT note_id, entity_value FROM entity_index) i ON i.note_id = v.note_id AND i.entity_value = a.entity_value GROUP BY 1, 2), ex AS (SELECT v.query_id, v.note_id, count(*) AS h FROM vec v JOIN (SELECT DISTINCT query_id, entity_value FROM asked) a USING (query_id) JOIN notes n ON n.note_id = v.note_id WHERE contains(lower(content_raw), lower(entity_value)) GROUP BY 1, 2) SELECT query_id, note_id, score * pow(2.5, coalesce(n, 0)) * pow(1.5, coalesce(h, 0)) AS score FROM vec LEFT JOIN sh USING (query_id, note_id) LEFT JOIN ex USING (query_id, note_id)")
_LINKS = "links AS (SELECT note_id, 'note_' || (CAST(substr(note_id, 6) AS BIGINT) + 1) AS related FROM notes)"
add("expand_links", _per_text(lambda t: retrieve.expand_links(_scored(t, 97), t.notes.select("note_id", F.concat(F.lit("note_"), F.substring("note_id", 6, 20).cast("long") + 1).alias("related")), 20)),
    f"{SCORED}, {_LINKS}, new AS (SELECT query_id, related AS note_id, max(score / 2) AS score FROM vec JOIN links USING (note_id) GROUP BY ALL), every AS (SELECT *, 0 AS hop FROM vec UNION ALL SELECT *, 1 FROM new WHERE (query_id, note_id) NOT IN (SELECT (query_id, note_id) FROM vec)) SELECT query_id, note_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, score DESC, note_id) AS k FROM every) r WHERE k <= 20")
add("temporal_boost", _per_text(lambda t: retrieve.temporal_boost(_scored(t, 97), t.questions, t.notes), every=True),
    f"{SCORED}, {INTENTS}, y AS (SELECT query_id, CASE WHEN intent = 'temporal' THEN nullif(regexp_extract(text, '\\b(?:19|20)\\d{{2}}\\b'), '') END AS year FROM intents), d AS (SELECT v.*, coalesce(contains(content_raw, year) OR CAST(year(created_at) AS VARCHAR) = year, false) AS dated FROM vec v LEFT JOIN y USING (query_id) JOIN notes n ON n.note_id = v.note_id) SELECT query_id, note_id, dated, row_number() OVER (PARTITION BY query_id ORDER BY dated DESC, score DESC, note_id) AS rank FROM d")
RANKED = f"{SCORED}, ranked AS (SELECT query_id, rank, note_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id) AS rank FROM vec) r WHERE rank <= 10)"


def _ranked(t: Tables) -> DataFrame:
    return fusion.top_of_entities(asked(t), _postings(t).withColumnRenamed("vs", "score").drop("gs"), 10).select("query_id", "rank", "note_id")


add("entity_augment", _per_text(lambda t: retrieve.entity_augment(cut(_ranked(t)), index.recall_entity(asked_index(t), asked(t), t.notes, 10))),
    f"{RANKED}, eh AS (SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, note_id) AS er FROM hits JOIN notes USING (note_id)), new AS (SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY er, note_id) AS k FROM eh WHERE er <= 10 AND (query_id, note_id) NOT IN (SELECT (query_id, note_id) FROM ranked)) SELECT * FROM ranked UNION ALL SELECT query_id, coalesce(last, 0) + k AS rank, note_id FROM new LEFT JOIN (SELECT query_id, max(rank) AS last FROM ranked GROUP BY 1) l USING (query_id) WHERE k <= 3")


def _causal(t: Tables) -> DataFrame:
    starts = t.customer.select(F.concat(F.lit("actor:"), F.col("c_custkey")).alias("node"))
    chain = graph.causal_chain(t.kg_edges.withColumn("edge_type", F.when(F.col("relationship") == "MENTIONED_IN", "causal").otherwise(F.col("edge_type"))), starts, True, 1)
    return retrieve.causal_augment(t.questions.select("query_id", F.lit("note:0").alias("note_id")), chain.withColumn("query_id", F.split_part("start", F.lit(":"), F.lit(2)).cast("long")))


add("causal_augment", _causal, f"{with_tables('kg_edges', 'questions')} SELECT query_id, 'note:0' AS note_id FROM questions UNION SELECT c_custkey, to_id FROM kg_edges JOIN customer ON from_id = 'actor:' || c_custkey WHERE relationship = 'MENTIONED_IN'")
add("rerank", _per_text(lambda t: retrieve.rerank(_ranked(t), t.questions, t.notes)), f"""{RANKED}, w AS (SELECT r.*, list_distinct(list_filter(string_split_regex(lower(q.text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(substr(n.content_raw, 1, 512)), '\\s+'), lambda x: x <> '')) AS b FROM ranked r JOIN questions q USING (query_id) JOIN notes n ON n.note_id = r.note_id),
s AS (SELECT query_id, rank AS before, note_id, round(len(list_intersect(a, b)) / len(a), 9) AS score FROM w) SELECT query_id, note_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, note_id) AS rank FROM s""")


def _recall(t: Tables) -> DataFrame:
    known = cut(entity_index(t))  # read by each step of the walks
    kind = F.when(F.col("entity_type") == "intrusion_set", "causal").otherwise("heuristic")
    edges = known.select(F.concat_ws(":", "entity_type", "entity_value").alias("from_id"), F.concat(F.lit("note:"), "note_id").alias("to_id"), F.lit("MENTIONED_IN").alias("relationship"), kind.alias("edge_type"))
    gone = t.kg_edges.where("relationship = 'SUPERSEDES'").select(F.concat(F.lit("note_"), F.split_part("to_id", F.lit(":"), F.lit(2))).alias("note_id"))
    return retrieve.recall(t.questions, t.notes, known, 10, superseded=gone, edges=edges)


add("recall", lambda t: _per_text(_recall)(t.with_table("questions", t.questions.where("query_id % 50 = 0"))))
add("format_context", _per_text(lambda t: retrieve.format_context(_ranked(t), t.notes, 100)), f"{RANKED} SELECT query_id, substr(string_agg('[' || rank || '] ' || substr(content_raw, 1, 300), chr(10) ORDER BY rank), 1, 400) AS context FROM ranked JOIN notes USING (note_id) GROUP BY 1")
_STOP = ", ".join(map(quoted, retrieve.QUESTION_STOPWORDS))


add("keyword_inject", _per_text(lambda t: retrieve.keyword_inject(t.questions, t.notes, cut(_ranked(t).select("query_id", "note_id")), 3)),
    f"{RANKED}, qw AS (SELECT DISTINCT query_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM questions), nw AS (SELECT DISTINCT note_id, unnest(string_split_regex(lower(content_raw), '\\s+')) AS w FROM notes), h AS (SELECT query_id, note_id, count(*) AS overlap FROM qw JOIN nw USING (w) WHERE w <> '' AND w NOT IN ({_STOP}) GROUP BY 1, 2) SELECT query_id, rank, note_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, note_id) AS rank FROM h WHERE (query_id, note_id) NOT IN (SELECT (query_id, note_id) FROM ranked)) r WHERE rank <= 3")
add("snippet", lambda t: t.documents.select("doc_id", retrieve.snippet(F.substring("text", 1, 60), F.col("text")).alias("snippet")),
    """WITH w AS (SELECT doc_id, list_distinct(string_split_regex(lower(substr(text, 1, 60)), '\\s+')) AS q, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
e AS (SELECT doc_id, q, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM w), o AS (SELECT doc_id, s, pos, len(list_intersect(q, list_distinct(string_split_regex(lower(s), '\\s+')))) AS n FROM e),
b AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS k FROM o) SELECT doc_id, substr(s, 1, 300) AS snippet FROM documents LEFT JOIN (SELECT * FROM b WHERE k = 1) x USING (doc_id)""")  # fmt: skip
add("relevant_sentences", lambda t: retrieve.relevant_sentences(t.documents.select("doc_id", "text", F.substring("text", 1, 80).alias("q")), "doc_id", "q", "text", 5),
    """WITH s AS (SELECT doc_id, substr(text, 1, 80) AS q, list_filter(list_transform(string_split(replace(text, chr(10), '. '), '.'), lambda x: trim(x)), lambda x: length(x) > 10) AS ss FROM documents),
e AS (SELECT doc_id, q, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM s), o AS (SELECT doc_id, sentence, pos, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(q), '\\s+'), lambda x: x <> '')), list_distinct(list_filter(string_split_regex(lower(sentence), '\\s+'), lambda x: x <> '')))) AS overlap FROM e)
SELECT doc_id, rank, sentence, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, pos) AS rank FROM o WHERE overlap > 0) r WHERE rank <= 5""")  # fmt: skip


def _sweep(t: Tables) -> DataFrame:
    """Questions of equal text are one, which counts as often as it is asked."""
    texts = t.questions.groupBy("text").agg(F.min("query_id").alias("query_id"), F.count("*").alias("asks"))
    t, asks = t.with_table("questions", texts.select("query_id", "text")), texts.select("query_id", "asks")
    rows = _scored(t, 97).withColumn("shared", F.col("score") % 3).join(asks, "query_id")
    truth = _hits(t).join(t.notes.where("tier = 'A'").select("note_id"), "note_id").join(asks, "query_id").select("query_id", "note_id", "asks")
    return retrieve.parameter_sweep(rows, truth, (10.0, 50.0, 90.0), (1.0, 1.5, 2.5))


add("parameter_sweep", _sweep, f"{SCORED}, truth AS (SELECT query_id, note_id FROM hits JOIN notes USING (note_id) WHERE tier = 'A'), p AS (SELECT * FROM (VALUES (10.0), (50.0), (90.0)) a(threshold), (VALUES (1.0), (1.5), (2.5)) b(boost)), r AS (SELECT threshold, boost, CASE WHEN t.note_id IS NULL THEN 0 ELSE 1 END AS hit FROM vec v CROSS JOIN p LEFT JOIN truth t ON t.query_id = v.query_id AND t.note_id = v.note_id WHERE v.score * pow(boost, v.score % 3) >= threshold) SELECT threshold, boost, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS returned, round(2 * sum(hit) / (count(*) + (SELECT count(*) FROM truth)), 6) AS f FROM r GROUP BY 1, 2")

# evolution and consolidation
FACTS = f"{NOTES}, facts AS (SELECT note_id, 'fact a ' || importance AS fact, 9 AS importance, 0 AS pos FROM notes UNION ALL SELECT note_id, 'fact b', 5, 1 FROM notes UNION ALL SELECT note_id, 'fact c', 10, 2 FROM notes)"


def _facts(t: Tables) -> DataFrame:
    return evolve.extract_facts(t.notes.select("note_id", F.format_string('[{"fact": "fact a %d", "importance": 9}, {"fact": "fact b", "importance": "high"}, {"fact": "fact c", "importance": 40}]', F.col("importance")).alias("json")), 2)


add("extract_facts", _facts, f"{FACTS} SELECT note_id, rank, fact, importance FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY importance DESC, pos) AS rank FROM facts) r WHERE rank <= 2")


def _similar(t: Tables) -> DataFrame:
    """Every 50th vector as a fact of the note it is named after, against the vectors of its label."""
    v = t.embeddings.select(F.col("vec_id").cast("string").alias("note_id"), F.concat(F.lit("d"), "label").alias("domain"), F.col("embedding").alias("vector"))
    facts = v.where("CAST(note_id AS BIGINT) % 50 = 0").withColumn("fact_id", F.concat(F.lit("f"), "note_id"))
    return evolve.find_similar(facts, v, 3)


add("find_similar", _similar, f"SELECT fact_id, rank, note_id, score FROM (SELECT 'f' || q.vec_id AS fact_id, CAST(v.vec_id AS VARCHAR) AS note_id, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, CAST(v.vec_id AS VARCHAR)) AS rank FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) r WHERE rank <= 3")


def _decided(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in ('{"operation": "update"}', '{"operation": "DELETE"}', '{"operation": "noop"}', "garbage", '{"operation": "ADD"}')]), (F.col("importance") % 5 + 1).cast("int"))
    return evolve.decide_operation(t.notes.select(F.col("note_id").alias("fact_id"), F.col("domain").alias("fact"), F.when(F.col("tier") != "C", F.concat(F.col("note_id"), F.lit("x"))).alias("neighbour"), said.alias("json")))


DECIDED = f"{NOTES}, decided AS (SELECT note_id AS fact_id, domain AS fact, CASE WHEN tier <> 'C' THEN note_id || 'x' END AS neighbour, CASE WHEN tier = 'C' THEN 'ADD' ELSE list_extract(['UPDATE', 'DELETE', 'NOOP', 'ADD', 'ADD'], CAST(importance % 5 + 1 AS INT)) END AS operation FROM notes)"
add("decide_operation", lambda t: _decided(t).drop("json"), f"{DECIDED} SELECT * FROM decided")
add("apply_operations", lambda t: evolve.apply_operations(_decided(t))[0], f"{DECIDED} SELECT fact_id, fact, CASE operation WHEN 'ADD' THEN 'added' WHEN 'UPDATE' THEN 'updated' ELSE 'corrected' END AS status FROM decided WHERE operation <> 'NOOP'")
_LIVE = "entity_index WHERE entity_type IN ('cve', 'actor', 'tool', 'campaign', 'asset', 'person', 'location', 'organization', 'event', 'activity', 'temporal')"
_SEARCHED = "CAST(substr(note_id, 6) AS BIGINT) % 50 = 0"


def _super(which: str) -> str:
    return f"{INDEX}, known AS (SELECT * FROM {_LIVE}), new AS (SELECT note_id AS new_id, created_at AS new_at FROM notes WHERE {which}), sh AS (SELECT new_id, b.note_id, count(*) AS n FROM new JOIN known a ON a.note_id = new_id JOIN known b ON b.entity_type = a.entity_type AND b.entity_value = a.entity_value AND b.note_id <> new_id GROUP BY 1, 2), sc AS (SELECT new_id, note_id, o.created_at, round(n + greatest(0, least((epoch(new_at) - epoch(o.created_at)) / 86400, 1)), 9) AS score FROM sh JOIN new USING (new_id) JOIN notes o USING (note_id)), pairs AS (SELECT new_id, note_id AS old_id, score FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, created_at DESC, note_id) AS k FROM sc) r WHERE k = 1 AND score >= 1)"


def _pairs(t: Tables, which: str = "true") -> DataFrame:
    return evolve.supersession_candidates(t.notes.where(which).select("note_id", "created_at"), t.notes, entity_index(t))


add("supersession_candidates", lambda t: _pairs(t, _SEARCHED), f"{_super(_SEARCHED)} SELECT * FROM pairs")
add("mark_superseded", lambda t: evolve.mark_superseded(_pairs(t), entity_index(t))[0], f"{_super('true')} SELECT 'note:' || new_id AS from_id, 'note:' || old_id AS to_id, 'SUPERSEDES' AS relationship FROM pairs")
add("superseded_notes", lambda t: evolve.superseded_notes(t.notes, _pairs(t)).select("note_id", "superseded_by", F.array_join("supersedes", ",").alias("supersedes")),
    f"{_super('true')}, o AS (SELECT old_id AS note_id, min(new_id) AS superseded_by FROM pairs GROUP BY 1), w AS (SELECT new_id AS note_id, string_agg(DISTINCT old_id, ',' ORDER BY old_id) AS supersedes FROM pairs GROUP BY 1) SELECT n.note_id, superseded_by, coalesce(supersedes, '') AS supersedes FROM notes n LEFT JOIN o ON o.note_id = n.note_id LEFT JOIN w ON w.note_id = n.note_id")


def shift_rows(t: Tables) -> DataFrame:
    """Notes by the actor they are about, with the entities of their text."""
    entities = F.array_union(extract.entity_values(F.col("content_raw"), "cve"), extract.entity_values(F.col("content_raw"), "tool"))
    actors = extract.primary_actor(t.notes).select("note_id", F.lower("primary_actor").alias("stream"))
    return t.notes.select("note_id", "created_at", "domain", entities.alias("entities")).join(actors, "note_id")


def _replayed(t: Tables) -> DataFrame:
    """Postings of the types that count for supersession are made once, for streams and replay."""
    known = cut(index.build_entity_index(extract.extract_all_long(t.notes, kinds=tuple(k for k in PATTERNS if k in evolve.SUPERSEDING))))
    return evolve.supersession_replay(evolve.entity_components(t.notes, known), known)


add("supersession_replay", _replayed)
#: Hours after which an entity that isn't seen counts as new again.
IDLE = 24.0 * 90
add("shift_detect", lambda t: evolve.shift_detect(shift_rows(t), idle=IDLE))
_RECENT = f"{INDEX}, gone AS (SELECT 'note_' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS note_id FROM orders), recent AS (SELECT note_id, domain FROM notes WHERE created_at >= TIMESTAMP '1996-01-01' AND note_id NOT IN (SELECT note_id FROM gone WHERE note_id IS NOT NULL)), cand AS (SELECT DISTINCT note_id FROM (SELECT r.note_id, count(*) OVER (PARTITION BY domain, entity_type, entity_value) AS n FROM recent r JOIN entity_index i ON i.note_id = r.note_id) x WHERE n >= 2 AND (SELECT count(*) FROM recent) >= 3)"
_NEG = "regexp_matches(lower(content_raw), 'not|never|no longer|ceased|discontinued|denied')"
_CONTRA = f"m AS (SELECT i.entity_type, i.entity_value, n.note_id, created_at, {_NEG} AS neg FROM entity_index i JOIN notes n ON n.note_id = i.note_id), g AS (SELECT entity_type, entity_value, neg, max((created_at, note_id)) AS last FROM m GROUP BY ALL), contra AS (SELECT DISTINCT m.note_id FROM m JOIN g ON g.entity_type = m.entity_type AND g.entity_value = m.entity_value AND g.neg <> m.neg AND g.last > (m.created_at, m.note_id))"


def _candidates(t: Tables) -> DataFrame:
    gone = t.kg_edges.where("relationship = 'SUPERSEDES'").select(F.concat(F.lit("note_"), F.split_part("to_id", F.lit(":"), F.lit(2))).alias("note_id"), F.col("from_id").alias("superseded_by"))
    return evolve.consolidation_candidates(t.notes.join(gone, "note_id", "left"), entity_index(t), "1996-01-01")


add("consolidation_candidates", _candidates, f"{_RECENT} SELECT note_id FROM cand")
add("contradictions", lambda t: evolve.contradictions(t.notes, entity_index(t)), f"{INDEX}, {_CONTRA} SELECT note_id FROM contra")
add("promote_tier", lambda t: evolve.promote_tier(t.notes, _candidates(t), evolve.contradictions(t.notes, entity_index(t))), f"{_RECENT}, {_CONTRA} SELECT note_id, CASE WHEN note_id IN (SELECT note_id FROM cand) AND note_id NOT IN (SELECT note_id FROM contra) THEN 'A' ELSE tier END AS tier FROM notes")
add("consolidation_report", lambda t: evolve.consolidation_report(t.notes, _candidates(t), evolve.contradictions(t.notes, entity_index(t))), f"{_RECENT}, {_CONTRA} SELECT count(*) AS candidates, count(x.note_id) AS contradicted, count(*) FILTER (WHERE x.note_id IS NULL AND tier <> 'A') AS promoted FROM cand JOIN notes USING (note_id) LEFT JOIN contra x ON x.note_id = cand.note_id")
add("evolution_candidates", lambda t: evolve.evolution_candidates(retrieve.vector_topk(*_vectors(t), 6, None), 5),
    f"SELECT query_id AS note_id, note_id AS neighbour, rank FROM (SELECT query_id, note_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ({_topk_sql(COS, 6)}) a WHERE query_id <> note_id) r WHERE rank <= 5")


def _decisions(t: Tables) -> DataFrame:
    said = F.element_at(F.array(F.lit('{"action": "keep"}'), F.concat(F.lit('{"action": "evolve", "content": "new text '), F.col("importance"), F.lit('"}')), F.lit('{"action": "evolve", "content": " "}'), F.lit("none")), (F.col("importance") % 4 + 1).cast("int"))
    return evolve.evolution_validate(t.notes.select("note_id", said.alias("json")))


DECISIONS = f"{NOTES}, dec AS (SELECT note_id, list_extract(['keep', 'evolve', 'evolve', NULL], CAST(importance % 4 + 1 AS INT)) AS action, CASE importance % 4 WHEN 1 THEN 'new text ' || importance WHEN 2 THEN ' ' END AS content, importance % 4 < 2 AS valid FROM notes)"
EVOLVED = f"{DECISIONS}, ev AS (SELECT n.note_id, CASE WHEN d.action = 'evolve' AND d.valid THEN content_raw END AS previous_raw, CASE WHEN d.action = 'evolve' AND d.valid THEN d.content ELSE content_raw END AS content_raw, CASE WHEN d.action = 'evolve' AND d.valid THEN evolution_count + 1 ELSE evolution_count END AS evolution_count, CASE WHEN d.action = 'evolve' AND d.valid THEN least(confidence, 0.95) ELSE confidence END AS confidence FROM notes n JOIN dec d USING (note_id))"
add("evolution_validate", _decisions, f"{DECISIONS} SELECT * FROM dec")


def _evolved(t: Tables) -> DataFrame:
    """Evolved notes, whose vectors were all zero before: ``embedded`` tells which were made anew."""
    rows = evolve.evolution_apply(t.notes.withColumn("vector", F.array_repeat(F.lit(0.0).cast("float"), retrieve.DIM)), _decisions(t))
    return rows.withColumn("embedded", F.exists("vector", lambda x: x != 0)).drop("vector")


add("evolution_apply", _evolved, f"{EVOLVED} SELECT *, previous_raw IS NOT NULL AS embedded FROM ev")
add("evolution_rollback", lambda t: evolve.evolution_rollback(evolve.evolution_apply(t.notes, _decisions(t))), f"{EVOLVED} SELECT note_id, NULL AS previous_raw, coalesce(previous_raw, content_raw) AS content_raw, CASE WHEN previous_raw IS NULL THEN evolution_count ELSE greatest(evolution_count - 1, 0) END AS evolution_count FROM ev")
add("evolution_report", lambda t: evolve.evolution_report(_decisions(t)), f"{DECISIONS} SELECT count(*) AS candidates, count(*) FILTER (WHERE valid) AS evaluated, count(*) FILTER (WHERE valid AND action = 'evolve') AS evolved, count(*) FILTER (WHERE valid AND action = 'keep') AS kept, count(*) FILTER (WHERE NOT valid) AS errors FROM dec")
