"""Queries on telemetry and on scoring answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate, telemetry
from .derived import Tables, with_tables
from .notes import INDEX, NOTES, entity_index
from .registry import add, add_alias

TEL = with_tables("telemetry")


def _results(t: Tables) -> DataFrame:
    return t.telemetry.where("event_type = 'recall'").select("query_id", F.col("event_id").alias("rank"), "note_id", "tier")


add("recall_events", lambda t: telemetry.recall_events(_results(t)).select("query_id", F.array_join(F.transform("notes", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["note_id"], x["tier"])), ",").alias("notes"), "result_count"), f"{TEL} SELECT query_id, string_agg(event_id || ':' || note_id || ':' || tier, ',' ORDER BY event_id) AS notes, count(*) AS result_count FROM telemetry WHERE event_type = 'recall' GROUP BY 1")
add("tier_distribution", lambda t: telemetry.tier_distribution(t.telemetry), f"{TEL} SELECT tier, count(*) AS n FROM telemetry WHERE event_type = 'recall' GROUP BY 1")
add("auto_feedback", lambda t: telemetry.auto_feedback(t.telemetry.where("event_type = 'recall'"), t.telemetry.where("event_type = 'synthesis'")), f"{TEL}, c AS (SELECT DISTINCT query_id, note_id FROM telemetry WHERE event_type = 'synthesis') SELECT DISTINCT r.query_id, r.note_id, CASE WHEN c.note_id IS NULL THEN 2 ELSE 4 END AS utility FROM telemetry r LEFT JOIN c ON c.query_id = r.query_id AND c.note_id = r.note_id WHERE event_type = 'recall'")
_W = "FILTER (WHERE event_type = '{}')"
add("daily_report", lambda t: telemetry.daily_report(t.telemetry), f"""{TEL} SELECT event_date, count(DISTINCT query_id) {_W.format('recall')} AS total_queries, count(*) {_W.format('synthesis')} AS total_synthesis, round(avg(duration_ms) {_W.format('recall')}, 2) AS avg_recall_latency_ms, round(avg(duration_ms) {_W.format('synthesis')}, 2) AS avg_synthesis_latency_ms,
round(avg(confidence) {_W.format('synthesis')}, 4) AS avg_confidence, count(*) {_W.format('feedback')} AS feedback_count, round(avg(utility) {_W.format('feedback')}, 2) AS avg_utility, CASE WHEN count(DISTINCT query_id) {_W.format('recall')} > 0 THEN round(count(*) {_W.format('recall')} / count(DISTINCT query_id) {_W.format('recall')}, 2) END AS notes_per_query FROM telemetry GROUP BY 1""")
add("top_utility_notes", lambda t: telemetry.top_utility_notes(t.telemetry), f"{TEL} SELECT note_id, CAST(sum(utility) AS BIGINT) AS utility FROM telemetry WHERE event_type = 'feedback' GROUP BY 1 ORDER BY utility DESC, note_id LIMIT 10")
add("unused_notes_uncited", lambda t: telemetry.unused_notes_uncited(t.telemetry), f"{TEL} SELECT note_id FROM telemetry WHERE event_type = 'recall' EXCEPT SELECT note_id FROM telemetry WHERE event_type = 'synthesis'")
add("unused_notes_low_utility", lambda t: telemetry.unused_notes_low_utility(t.telemetry, 5), f"{TEL} SELECT note_id FROM telemetry WHERE event_type = 'recall' EXCEPT SELECT note_id FROM telemetry WHERE event_type = 'feedback' AND utility >= 5")
add("daily_volume", lambda t: telemetry.daily_volume(t.telemetry), f"{TEL} SELECT event_date, event_type, count(*) AS n FROM telemetry GROUP BY 1, 2")
add("daily_volume_wide", lambda t: telemetry.daily_volume_wide(t.telemetry), f"{TEL} SELECT event_date, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("recall", "synthesis", "feedback", "human_eval")) + " FROM telemetry GROUP BY 1")
add("latency_percentiles", lambda t: telemetry.latency_percentiles(t.telemetry), f"{TEL} SELECT event_type, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, max(duration_ms) AS max_ms FROM telemetry GROUP BY 1")
add("latency_nearest_rank", lambda t: telemetry.latency_nearest_rank(t.telemetry), f"{TEL}, s AS (SELECT event_type, list(duration_ms ORDER BY duration_ms) AS l FROM telemetry WHERE duration_ms IS NOT NULL GROUP BY 1) SELECT event_type, l[CAST(floor(len(l) / 2) AS INT) + 1] AS p50, l[CAST(floor(len(l) * 95 / 100) AS INT) + 1] AS p95 FROM s")
add("utility_trend", lambda t: telemetry.utility_trend(t.telemetry), f"{TEL} SELECT event_date, round(avg(utility), 6) AS mean_utility FROM telemetry WHERE event_type = 'feedback' GROUP BY 1")
add("top_intents", lambda t: telemetry.top_intents(t.telemetry), f"{TEL} SELECT intent, count(*) AS n FROM telemetry GROUP BY 1")
add("history", lambda t: telemetry.history(t.telemetry, "2024-01-20", 7, 50).select("event_id", "event_date", "event_type"), f"{TEL} SELECT event_id, event_date, event_type FROM telemetry WHERE event_date > DATE '2024-01-13' AND event_date <= DATE '2024-01-20' ORDER BY ts DESC, event_id LIMIT 50")
add("human_eval_sample", lambda t: telemetry.human_eval_sample(t.telemetry).select("event_id", "note_id"), f"{TEL} SELECT event_id, note_id FROM telemetry WHERE event_type = 'synthesis' ORDER BY md5(event_id || ':7') LIMIT 20")
add("operation_metrics", lambda t: telemetry.operation_metrics(t.telemetry), f"{TEL} SELECT event_type, count(*) AS n, round(100 * avg(CASE WHEN duration_ms > 50 THEN 1.0 ELSE 0.0 END), 6) AS slow_percent, round(avg(duration_ms), 6) AS mean_ms FROM telemetry GROUP BY 1")
add("rate_violations", lambda t: telemetry.rate_violations(t.events, "event_type", 3, 3600), "SELECT event_id, event_type, n FROM (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events) x WHERE n > 3")


_KINDS = ("api", "authentication", "authorization", "config", "file", "process", "account", "other")
_DONE = ("Create", "Read", "Update", "Delete", "Start", "Crash", "Disable", "recall", "Stop", "Restart", "none")


def _at(values: tuple[str, ...]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))


def _logs(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", _at(_KINDS).alias("kind"), _at(_DONE).alias("activity"), (F.col("event_id") % 7).cast("int").alias("severity_id"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"))


def _told_logs(t: Tables) -> DataFrame:
    """Logs with what events tell of classes: an empty actor for every 13th user, values at every third event."""
    user = F.col("user_id").cast("string")
    some = {
        "actor": F.when(F.col("user_id") % 13 == 0, "").otherwise(F.concat(F.lit("u"), user)), "resource": F.when(F.col("event_id") % 17 == 0, "").otherwise(F.concat(F.lit("r"), user)),
        "duration_ms": F.col("value"), "auth_protocol": F.lit("api_key"), "src_endpoint": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10.0.0."), user)), "privileges": F.when(F.col("event_id") % 3 == 0, "write"),
        "policy": F.when(F.col("event_id") % 5 == 0, ""), "prev_value": F.when(F.col("event_id") % 3 == 0, ""), "new_value": F.when(F.col("event_id") % 3 > 0, "on"),
        "file_path": F.concat(F.lit("/f/"), user), "process_name": F.concat(F.lit("p"), user), "user": F.concat(F.lit("target"), user),
    }
    return _logs(t).join(t.events.select("event_id", *[v.alias(k) for k, v in some.items()]), "event_id")


def _flat_events(t: Tables) -> DataFrame:
    rows = telemetry.ocsf_normalize(_told_logs(t))
    nested = {"actor": "actor.user.name", "src_ip": "src_endpoint.ip", "file_path": "file.path", "process_name": "process.name", "user_name": "user.name"}
    return rows.select(*[c for c in rows.columns if c not in ("actor", "src_endpoint", "file", "process", "user")], *[F.col(path).alias(name) for name, path in nested.items()])


_SQL_AT = lambda values: f"list_extract([{', '.join(map(repr, values))}], CAST(event_id % {len(values)} + 1 AS INT))"
add("ocsf_normalize", _flat_events, f"""WITH c AS (SELECT * FROM (VALUES ('api', 6002, 'API Activity', 6, 'Application Activity'), ('authentication', 3001, 'Authentication', 3, 'Identity & Access Management'), ('authorization', 3003, 'Authorization', 3, 'Identity & Access Management'), ('config', 5002, 'Configuration Change', 5, 'Discovery'), ('file', 1001, 'File Activity', 1, 'System Activity'), ('process', 1007, 'Process Activity', 1, 'System Activity'), ('account', 3005, 'Account Change', 3, 'Identity & Access Management')) v(kind, class_uid, class_name, category_uid, category_name)),
l AS (SELECT *, {_SQL_AT(_KINDS)} AS kind, {_SQL_AT(_DONE)} AS done, event_type <> 'error' AS ok FROM events),
a AS (SELECT *, CASE kind WHEN 'api' THEN CASE WHEN ok THEN 1 ELSE 2 END WHEN 'authorization' THEN CASE WHEN ok THEN 1 ELSE 2 END WHEN 'authentication' THEN 1 WHEN 'config' THEN 1
WHEN 'file' THEN CASE done WHEN 'Create' THEN 1 WHEN 'Read' THEN 2 WHEN 'Update' THEN 3 WHEN 'Delete' THEN 4 ELSE 0 END
WHEN 'process' THEN CASE done WHEN 'Start' THEN 1 WHEN 'Stop' THEN 2 WHEN 'Crash' THEN 3 WHEN 'Restart' THEN 4 ELSE 0 END
WHEN 'account' THEN CASE done WHEN 'Create' THEN 1 WHEN 'Update' THEN 2 WHEN 'Disable' THEN 3 WHEN 'Delete' THEN 4 ELSE 0 END ELSE 0 END AS activity_id,
CASE kind WHEN 'authentication' THEN 'Logon' WHEN 'config' THEN 'Update' WHEN 'authorization' THEN CASE WHEN ok THEN 'Access Grant' ELSE 'Access Deny' END ELSE done END AS activity_name FROM l)
SELECT event_id, class_uid, class_name, category_uid, category_name, CAST(event_id % 7 AS INT) AS severity_id, coalesce(list_extract(['Unknown', 'Informational', 'Low', 'Medium', 'High', 'Critical'], CAST(event_id % 7 AS INT) + 1), 'Unknown') AS severity, activity_id, activity_name, CASE WHEN ok THEN 1 ELSE 2 END AS status_id, CASE WHEN ok THEN 'Success' ELSE 'Failure' END AS status,
strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, 0 AS timezone_offset, class_uid * 100 + activity_id AS type_uid,
CASE WHEN kind IN ('authentication', 'authorization', 'account') OR (kind IN ('api', 'config', 'file') AND user_id % 13 <> 0) THEN CASE WHEN user_id % 13 = 0 THEN '' ELSE 'u' || user_id END END AS actor,
CASE WHEN kind IN ('authorization', 'config') OR (kind = 'api' AND event_id % 17 <> 0) THEN CASE WHEN event_id % 17 = 0 THEN '' ELSE 'r' || user_id END END AS resource,
CASE WHEN kind IN ('api', 'file') THEN round(value, 2) END AS duration_ms, CASE WHEN kind = 'authentication' THEN 'api_key' END AS auth_protocol,
CASE WHEN kind = 'authentication' AND event_id % 2 = 0 THEN '10.0.0.' || user_id END AS src_ip, CASE WHEN kind = 'authorization' AND event_id % 3 = 0 THEN 'write' END AS privileges, CAST(NULL AS VARCHAR) AS policy,
CASE WHEN kind IN ('config', 'account') AND event_id % 3 = 0 THEN '' END AS prev_value, CASE WHEN kind IN ('config', 'account') AND event_id % 3 > 0 THEN 'on' END AS new_value,
CASE WHEN kind = 'file' THEN '/f/' || user_id END AS file_path, CASE WHEN kind = 'process' THEN 'p' || user_id END AS process_name, CASE WHEN kind = 'account' THEN 'target' || user_id END AS user_name
FROM a LEFT JOIN c USING (kind)""")
add("log_tail", lambda t: telemetry.log_tail(_logs(t), 100, "ERROR").select("event_id", "level"), "SELECT event_id, 'ERROR' AS level FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) x WHERE event_type = 'error'")

# scoring
PRED = with_tables("predictions")
_PUNCT = "[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]"
_WORDS = "list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> '')"


def _norm(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(regexp_replace(lower({c}), '{_PUNCT}', '', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the')), ' ')"


_SPLIT = PRED + f", p AS (SELECT *, predicted AS answer, list_distinct({_WORDS.format('gold')}) AS want, list_distinct({_WORDS.format('predicted')}) AS have FROM predictions)"


def _answers(t: Tables) -> DataFrame:
    """Each turn of a conversation is an answer, the turn before it its gold text, both whole."""
    return t.predictions.withColumn("answer", F.col("predicted"))


JUDGED = f"{_SPLIT}, judged AS (SELECT doc_id, category, CASE WHEN contains(lower(answer), lower(gold)) THEN 1.0 WHEN len(want) = 0 THEN 0.0 WHEN len(list_intersect(want, have)) / len(want) >= 0.7 THEN 1.0 WHEN len(list_intersect(want, have)) / len(want) >= 0.3 THEN 0.5 ELSE 0.0 END AS score FROM p)"


def _judged(t: Tables) -> DataFrame:
    return _answers(t).select("doc_id", "category", evaluate.keyword_judge(F.col("answer"), F.col("gold")).alias("score"))


add("keyword_judge", lambda t: _judged(t), f"{JUDGED} SELECT * FROM judged")
add("normalize_answer", lambda t: _answers(t).select("doc_id", evaluate.normalize_answer(F.col("predicted")).alias("answer")), f"{PRED} SELECT doc_id, {_norm('predicted')} AS answer FROM predictions")
_F1 = f"{_SPLIT}, a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split({_norm('answer')}, ' ')) AS w FROM p) x WHERE w <> '' GROUP BY 1, 2), b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split({_norm('gold')}, ' ')) AS w FROM p) x WHERE w <> '' GROUP BY 1, 2), s AS (SELECT doc_id, sum(CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0 ELSE least(a.n, b.n) END) AS same, sum(a.n) AS np, sum(b.n) AS ng FROM a FULL JOIN b USING (doc_id, w) GROUP BY 1), f1 AS (SELECT p.doc_id, CASE WHEN coalesce(same, 0) > 0 THEN round(same / np, 6) ELSE 0 END AS precision, CASE WHEN coalesce(same, 0) > 0 THEN round(same / ng, 6) ELSE 0 END AS recall, CASE WHEN coalesce(same, 0) > 0 THEN round(2 * (same / np) * (same / ng) / (same / np + same / ng), 6) ELSE 0 END AS f1 FROM p LEFT JOIN s USING (doc_id))"
add("token_f1", lambda t: evaluate.token_f1(_answers(t), "doc_id", "answer", "gold"), f"{_F1} SELECT * FROM f1")
add("exact_match", lambda t: t.predictions.select("doc_id", evaluate.exact_match(F.col("predicted"), F.col("gold")).alias("score")), f"{PRED} SELECT doc_id, CAST({_norm('predicted')} = {_norm('gold')} AS DOUBLE) AS score FROM predictions")
add("substring_match", lambda t: t.predictions.select("doc_id", evaluate.substring_match(F.col("predicted"), F.col("gold")).alias("score")), f"{PRED} SELECT doc_id, CAST(contains({_norm('predicted')}, {_norm('gold')}) AS DOUBLE) AS score FROM predictions")
add("best_of_gold", lambda t: evaluate.best_of_gold(evaluate.token_f1(_answers(t), "doc_id", "answer", "gold").join(t.predictions.select("doc_id", "category"), "doc_id").withColumnRenamed("doc_id", "gold_id"), "category"), f"{_F1} SELECT category, arg_min(doc_id, (-f1, doc_id)) AS gold_id, max(f1) AS f1 FROM f1 JOIN predictions USING (doc_id) GROUP BY 1")


def _sets(t: Tables, col: str) -> DataFrame:
    return t.predictions.select("doc_id", F.explode(F.split(col, " ")).alias("value"))


_SETS = f"{PRED}, a AS (SELECT DISTINCT doc_id, unnest(string_split(predicted, ' ')) AS v FROM predictions), b AS (SELECT DISTINCT doc_id, unnest(string_split(gold, ' ')) AS v FROM predictions)"
add("set_prf", lambda t: evaluate.set_prf(_sets(t, "predicted"), _sets(t, "gold"), "doc_id"), f"{_SETS}, z AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(*) FILTER (WHERE a.v IS NOT NULL AND b.v IS NOT NULL) AS tp, count(a.v) AS np, count(b.v) AS ne FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.v = b.v GROUP BY 1) SELECT doc_id, round(tp / np, 6) AS precision, round(tp / ne, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * (tp / np) * (tp / ne) / (tp / np + tp / ne) ELSE 0 END, 6) AS f1 FROM z")
add("attribution_score", lambda t: _answers(t).select("doc_id", evaluate.attribution_score(F.col("answer"), F.col("gold")).alias("score")), f"{_SPLIT} SELECT doc_id, CASE WHEN trim(gold) <> '' AND trim(answer) <> '' AND (contains(trim(answer), trim(gold)) OR contains(trim(gold), trim(answer))) THEN 1.0 WHEN trim(gold) <> '' AND len(list_intersect(want, have)) / len(want) >= 0.5 THEN 0.5 ELSE 0.0 END AS score FROM p")
add("set_recall_in_text", lambda t: evaluate.set_recall_in_text(_sets(t, "gold"), _answers(t).select("doc_id", F.col("answer").alias("text")), "doc_id"), f"{_SETS}, x AS (SELECT b.doc_id, contains(predicted, v) AS hit FROM b JOIN predictions p ON p.doc_id = b.doc_id) SELECT doc_id, count(*) FILTER (WHERE hit) AS found, count(*) AS wanted, round(count(*) FILTER (WHERE hit) / count(*), 6) AS recall FROM x GROUP BY 1")


def _contexts(t: Tables) -> tuple[DataFrame, DataFrame]:
    return _answers(t).select("category", F.col("answer").alias("text")), t.predictions.groupBy("category").agg(F.min("gold").alias("gold"))


add("context_precision", lambda t: evaluate.context_precision(*_contexts(t), "category"), f"{PRED}, g AS (SELECT category, list_distinct({_WORDS.format('min(gold)')}) AS g FROM predictions GROUP BY 1) SELECT category, round(avg(CASE WHEN len(list_filter(g, lambda w: contains(predicted, w))) > 0 THEN 1.0 ELSE 0.0 END), 6) AS precision FROM predictions JOIN g USING (category) GROUP BY 1")
add("keyword_presence", lambda t: _answers(t).select("doc_id", F.round(evaluate.keyword_presence(F.col("gold"), F.col("answer")), 6).alias("presence")), f"{_SPLIT} SELECT doc_id, round(CASE WHEN len(want) = 0 THEN 0 ELSE len(list_filter(want, lambda w: contains(lower(answer), w))) / len(want) END, 6) AS presence FROM p")


add("negative_score", lambda t: evaluate.negative_score(t.documents, t.labels.where("toxic = 1"), "doc_id"), "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 0.0 ELSE 1.0 END AS score FROM documents")


def _status():
    return F.element_at(F.array(*[F.lit(x) for x in ("Created", "updated ", "noop", "corrected")]), (F.col("importance") % 4 + 1).cast("int"))
add("evolve_score", lambda t: t.notes.select("note_id", evaluate.evolve_score(F.when(F.col("importance") != 7, _status()), F.when(F.col("tier") == "A", "added").otherwise("updated"), F.array(F.lit("noop"))).alias("score")), f"{NOTES}, s AS (SELECT note_id, tier, CASE WHEN importance = 7 THEN 'unknown' ELSE list_extract(['added', 'updated', 'noop', 'corrected'], CAST(importance % 4 + 1 AS INT)) END AS st FROM notes) SELECT note_id, CASE WHEN st = CASE WHEN tier = 'A' THEN 'added' ELSE 'updated' END THEN 1.0 WHEN st = 'noop' THEN 0.5 ELSE 0.0 END AS score FROM s")
add("accuracy_by_category", lambda t: evaluate.accuracy_by_category(_judged(t)), f"{JUDGED} SELECT category, count(*) AS n, round(100 * avg(CAST(score = 1 AS DOUBLE)), 6) AS exact_percent, round(avg(score), 6) AS mean_score FROM judged GROUP BY ROLLUP (category)")
#: Other names of the same queries.
for _name in ("keyword_judge", "normalize_answer", "token_f1", "exact_match", "substring_match", "best_of_gold", "set_prf", "attribution_score", "set_recall_in_text", "context_precision", "keyword_presence", "accuracy_by_category"):
    add_alias(f"whole_{_name}", _name)
add("qa_sample_per_category", lambda t: evaluate.qa_sample_per_category(t.predictions, "category", "doc_id", 5).select("doc_id", "category"), f"{PRED} SELECT doc_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS k FROM predictions) x WHERE k <= 5")


def _spans(t: Tables) -> DataFrame:
    spans = t.documents.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), (F.col("doc_id") % 7 + a).alias("start"), (F.col("doc_id") % 7 + b).alias("end")) for n, a, b in (("Actor", 0, 8), ("Tool", 5, 12))])).alias("s")).select("doc_id", "s.*")
    return evaluate.span_entities(t.documents.select("doc_id", "text"), spans, "doc_id")


add("span_entities", _spans, "SELECT doc_id, 'Actor' AS label, substr(text, CAST(doc_id % 7 AS INT) + 1, 8) AS value FROM documents UNION ALL SELECT doc_id, 'Tool', substr(text, CAST(doc_id % 7 AS INT) + 6, 7) FROM documents")
add("generate_qa", lambda t: evaluate.generate_qa(entity_index(t)), f"""{INDEX}, c AS (SELECT entity_type, entity_value, count(DISTINCT note_id) AS n FROM entity_index GROUP BY 1, 2 HAVING count(DISTINCT note_id) >= 2), ab AS (SELECT a.entity_value AS actor, b.entity_value AS tool, count(*) AS n FROM entity_index a JOIN entity_index b ON a.note_id = b.note_id AND a.entity_type = 'intrusion_set' AND b.entity_type = 'tool' GROUP BY 1, 2), ok AS (SELECT * FROM ab WHERE n >= 2),
neg AS (SELECT actor, tool FROM (SELECT DISTINCT actor FROM ok) x, (SELECT DISTINCT entity_value AS tool FROM entity_index WHERE entity_type = 'tool') y EXCEPT SELECT actor, tool FROM ab)
SELECT 'count' AS kind, 'How many notes mention ' || entity_value || '?' AS question, CAST(n AS VARCHAR) AS answer, n FROM c UNION ALL SELECT 'uses', 'Does ' || actor || ' use ' || tool || '?', 'yes', n FROM ok UNION ALL SELECT 'negative', 'Does ' || actor || ' use ' || tool || '?', 'no', 0 FROM neg""")
add("generate_corpus", lambda t: evaluate.generate_corpus(t.orders, "o_orderkey"))
