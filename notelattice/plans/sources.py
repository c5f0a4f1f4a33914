"""Queries on readers, writers and streams: derived tables are written in a reader's format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import shared_path
from ..operators import index
from ..sources import tables
from ..sources.buckets import BucketTable
from ..sources.logtail import read_log_stream
from ..streaming import jobs
from .derived import Tables, with_tables
from .notes import INDEX, NOTES, entity_index
from .registry import add
from .retrieve import IDLE, shift_rows


def _lines(t: Tables, name: str, *rows: DataFrame) -> str:
    """The folder of text lines of ``rows`` (value)."""
    path = shared_path(t.spark, name)
    for k, df in enumerate(rows):
        df.write.mode("append" if k else "errorifexists").text(path)
    return path


def _files(t: Tables, name: str, rows: DataFrame, key: str) -> str:
    """A folder of text files, one folder for each ``key`` of ``rows`` (key, value)."""
    path = shared_path(t.spark, name)
    rows.repartition(key).write.partitionBy(key).option("lineSep", "\n").text(path)
    return path


def _json(*columns):
    return F.to_json(F.struct(*columns)).alias("value")


def _note_log(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = t.notes.select("note_id", "domain", "importance")
    old = n.select(_json("note_id", F.lit("old").alias("domain"), "importance", F.lit("2024-01-01").alias("updated_at")))
    new = n.where("importance > 3").select(_json("note_id", "domain", "importance", F.lit("2024-02-01").alias("updated_at")))
    broken = n.where("importance = 10").select(F.concat(F.lit("{broken "), "note_id").alias("value"))
    return tables.read_notes_jsonl(t.spark, _lines(t, "note-log", old, new, broken), "note_id string, domain string, importance int, updated_at string")


add("read_notes_jsonl", lambda t: _note_log(t)[0], f"{NOTES} SELECT note_id, CASE WHEN importance > 3 THEN domain ELSE 'old' END AS domain, importance, CASE WHEN importance > 3 THEN '2024-02-01' ELSE '2024-01-01' END AS updated_at FROM notes")
add("read_notes_jsonl_rejects", lambda t: _note_log(t)[1].select(F.col("_corrupt").alias("line")), f"{NOTES} SELECT '{{broken ' || note_id AS line FROM notes WHERE importance = 10")


def _kg_log(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = t.customer.select("c_custkey", F.concat(F.lit("n"), "c_custkey").alias("node_id"))
    nodes = [c.select(_json("node_id", F.lit("actor").alias("entity_type"), F.concat(F.lit(v), "c_custkey").alias("entity_value"), F.lit(at).alias("updated_at"))) for v, at in (("new", "2024-02-01"), ("old", "2024-01-01"))]
    o = t.orders.select(F.concat(F.lit("e"), "o_orderkey").alias("edge_id"), F.concat(F.lit("n"), "o_custkey").alias("a"), F.concat(F.lit("p"), F.col("o_orderkey") % 50).alias("b"), "o_orderkey")
    now = o.where("o_orderkey % 2 = 0").select(_json("edge_id", F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("USES").alias("relationship"), F.lit("2024-01-01").alias("updated_at")))
    legacy = o.where("o_orderkey % 2 = 1").select(_json("edge_id", F.col("a").alias("source_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("b")).alias("target_id"), F.lit("KNOWS").alias("relation_type")))
    again = o.where("o_orderkey % 4 = 0").select(_json("edge_id", F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("LEFT").alias("relationship"), F.lit("2024-03-01").alias("updated_at")))
    broken = o.where("o_orderkey % 10 = 0").select(F.lit("{no json").alias("value"))
    return tables.read_kg_log(t.spark, _lines(t, "kg-nodes", *nodes), _lines(t, "kg-edges", now, legacy, again, broken))


add("read_kg_log", lambda t: _kg_log(t)[1].select("edge_id", "from_id", "to_id", "relationship"), "SELECT 'e' || o_orderkey AS edge_id, 'n' || o_custkey AS from_id, 'p' || (o_orderkey % 50) AS to_id, CASE WHEN o_orderkey % 4 = 0 THEN 'LEFT' WHEN o_orderkey % 2 = 0 THEN 'USES' ELSE 'KNOWS' END AS relationship FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 > 0")
add("read_kg_log_nodes", lambda t: _kg_log(t)[0].select("node_id", "entity_value"), "SELECT 'n' || c_custkey AS node_id, 'new' || c_custkey AS entity_value FROM customer")
add("read_kg_log_skipped", lambda t: _kg_log(t)[2], "SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0) + count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0) AS skipped FROM orders")


def _events(t: Tables) -> DataFrame:
    rows = t.events.select(_json("event_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp")))
    broken = t.events.where("event_id % 7 = 0").select(F.lit("{cut off").alias("value"))
    return tables.read_telemetry(t.spark, _lines(t, "telemetry", rows, broken), "event_id long, event_type string, timestamp long")


add("read_telemetry", lambda t: _events(t).select("event_id", "event_type", F.date_format("event_date", "yyyy-MM-dd").alias("event_date")), "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS event_date FROM events")


def _index_docs(t: Tables) -> DataFrame:
    """The index as documents {type: {value: [note]}}, one for each type and value."""
    i = entity_index(t).groupBy("entity_type", "entity_value").agg(F.sort_array(F.collect_set("note_id")).alias("ids"))
    return i.select(F.to_json(F.create_map("entity_type", F.create_map("entity_value", "ids"))).alias("value"))


add("load_entity_index_map", lambda t: tables.load_entity_index_map(t.spark.read.text(_lines(t, "index-map", _index_docs(t)))), f"{INDEX} SELECT entity_type, entity_value, note_id FROM entity_index")
add("rebuild_indexes", lambda t: index.rebuild_indexes(t.notes)[1], f"{INDEX} SELECT entity_type, count(DISTINCT entity_value) AS entities, count(*) AS postings, (SELECT count(*) FROM notes) AS notes_indexed FROM entity_index GROUP BY 1")


def _bundles(t: Tables) -> str:
    """Bundles of parts as attack patterns, suppliers as intrusion sets, and customers as reports, a file for each nation or size."""
    ref = lambda name, i: F.array(F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id")), F.struct(name.alias("source_name"), i.alias("external_id")))
    key = F.col("p_partkey")
    part = t.part.select(F.concat(F.lit("s"), "p_size").alias("file"), F.struct(
        F.lit("attack-pattern").alias("type"), F.concat(F.lit("ap--"), key).alias("id"), F.col("p_name").alias("name"), (key % 11 == 0).alias("revoked"), F.lit(None).cast("boolean").alias("x_mitre_deprecated"),
        ref(F.when(key % 5 == 0, "capec").otherwise("mitre-attack"), F.concat(F.lit("T"), key, F.when(key % 3 == 0, ".001").otherwise(""))).alias("external_references")).alias("o"))
    thing = lambda kind, i, name: F.struct(kind.alias("type"), i.alias("id"), name.alias("name"), F.lit("2024-01-01").alias("created"))
    supplier = t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("file"), thing(F.lit("intrusion-set"), F.concat(F.lit("is--"), "s_suppkey"), F.col("s_name")).alias("o"))
    told = F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("about "), "c_custkey"))  # every seventh report tells nothing
    report = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("file"), F.struct(F.lit("report").alias("type"), F.concat(F.lit("rp--"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("2024-01-01").alias("created"), told.alias("description")).alias("o"))
    tool = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("file"), thing(F.when(F.col("n_nationkey") % 2 == 0, "malware").otherwise("tool"), F.concat(F.lit("tl--"), "n_nationkey"), F.col("n_name")).alias("o"))
    link = lambda a, b, kind: F.struct(F.lit("relationship").alias("type"), kind.alias("relationship_type"), a.alias("source_ref"), b.alias("target_ref"))
    uses = t.supplier.where("s_suppkey % 4 > 0").select(F.concat(F.lit("n"), "s_nationkey").alias("file"), link(F.concat(F.lit("is--"), "s_suppkey"), F.concat(F.lit("tl--"), "s_nationkey"), F.when(F.col("s_suppkey") % 4 == 1, "targets").otherwise("uses")).alias("o"))
    tells = t.customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("n"), "c_nationkey").alias("file"), link(F.concat(F.lit("rp--"), "c_custkey"), F.concat(F.lit("tl--"), "c_nationkey"), F.lit("indicates")).alias("o"))
    every = None
    for rows in (part, supplier, report, tool, uses, tells):
        one = rows.select("file", F.to_json("o").alias("o"))
        every = one if every is None else every.union(one)
    # each file has lines of its own around its objects, in three ranges of its one sorted partition
    ends = every.select("file").distinct().select("file", F.explode(F.expr("array(struct(0 AS k, '{\"type\": \"bundle\", \"objects\": [' AS value), struct(2 AS k, '{\"type\": \"none\"}]}' AS value))")).alias("e")).select("file", "e.k", "e.value")
    path = shared_path(t.spark, "stix")
    lines = every.select("file", F.lit(1).alias("k"), F.concat("o", F.lit(",")).alias("value")).union(ends)
    lines.repartition("file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(path)
    return path


add("read_stix_bundle", lambda t: tables.read_stix_bundle(t.spark, _bundles(t)), "SELECT 'T' || p_partkey AS technique_id, p_name AS name FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 <> 0")
add("stix_technique_ids", lambda t: tables.stix_technique_ids(tables.read_stix_objects(t.spark, _bundles(t))).select("id", "name", "mitre_id"), "SELECT 'ap--' || p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN 'T' || p_partkey || '.001' ELSE 'T' || p_partkey END AS mitre_id FROM part")
add("stix_extract_actor_tools", lambda t: tables.stix_extract_actor_tools(tables.read_stix_objects(t.spark, _bundles(t))).select("id", "name", "kind", "used"), "SELECT 'is--' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 > 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'malware' ELSE 'tool' END END AS kind, CASE WHEN s_suppkey % 4 > 1 THEN n_name END AS used FROM supplier JOIN nation ON s_nationkey = n_nationkey")
add("stix_extract_reports", lambda t: tables.stix_extract_reports(tables.read_stix_objects(t.spark, _bundles(t))).select("id", "name", "created", "description", "kind", "entity"), "SELECT 'rp--' || c_custkey AS id, c_name AS name, '2024-01-01' AS created, 'about ' || c_custkey AS description, CASE WHEN c_custkey % 3 = 0 AND n_nationkey % 2 = 0 THEN 'malware' END AS kind, CASE WHEN c_custkey % 3 = 0 AND n_nationkey % 2 = 0 THEN n_name END AS entity FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 > 0")


def _hunts(t: Tables) -> DataFrame:
    text = F.concat(F.lit("---\nhunt_id: H-"), "n_nationkey", F.lit("\n---\n## LEARN\nabout "), "n_name", F.lit("\n## OBSERVE\nlogs\n## CHECK\n\n## KEEP\nnotes"))
    return t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, "no id").otherwise(text).alias("value"))


add("read_hunt_markdown", lambda t: tables.read_hunt_markdown(t.spark, _files(t, "hunts", _hunts(t), "n_nationkey")), "SELECT 'H-' || n_nationkey AS hunt_id, 'about ' || n_name AS learn, 'logs' AS observe, '' AS check, 'notes' AS keep FROM nation WHERE n_nationkey % 5 <> 0")


def _dialogues(t: Tables) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text")))
    docs = t.conversations.groupBy("conv_id").agg(turns.alias("turns"))  # a dialogue is a document
    sessions = F.create_map(F.lit("s1"), F.transform("turns", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))))
    return docs.select((F.col("conv_id") % 4).alias("part"), _json(F.concat(F.lit("c"), "conv_id").alias("sample_id"), sessions.alias("sessions")))


def _flat(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "dialogues")
    _dialogues(t).select("value").write.text(path)
    return tables.flatten_conversations(t.spark, path, many=True)


add("flatten_conversations", _flat, "SELECT 'c' || conv_id AS sample_id, 's1' AS session, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS turn, role AS speaker, text FROM conversations")


def _vector_rows(t: Tables) -> DataFrame:
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 5 > 0, F.col("embedding"))
    return t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("d"), "label").alias("domain"), v.alias("vector"), F.repeat(F.lit("ab"), 300).alias("content"))


def _written_vectors(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "vectors")
    tables.write_vector_table(_vector_rows(t), path, 64)
    got = t.spark.read.parquet(path)
    return got.select("id", "domain", F.size("vector").alias("dim"), F.exists("vector", lambda x: x != 0).alias("given"), F.length("content").alias("length"))


add("write_vector_table", _written_vectors, "SELECT vec_id AS id, 'd' || label AS domain, 64 AS dim, vec_id % 5 > 0 AS given, 500 AS length FROM embeddings WHERE vec_id % 7 <> 0")
add("snapshot_export", lambda t: t.spark.read.parquet(tables.snapshot_export(t.nation, shared_path(t.spark, "snapshots"), "one")), "SELECT * FROM nation")


def _bucketed(t: Tables) -> DataFrame:
    """Customers upserted twice and some deleted, in a table of buckets; with a snapshot taken before the deletion."""
    table = BucketTable(t.spark, shared_path(t.spark, "bucket-table"), "c_custkey", "at", 16)
    rows = t.customer.select("c_custkey", "c_name", F.col("c_acctbal").alias("at"))
    table.upsert(rows)
    table.upsert(rows.where("c_custkey % 10 = 0").select("c_custkey", F.lit("renamed").alias("c_name"), (F.col("at") + 1).alias("at")))
    table.snapshot("before")
    table.delete(rows.where("c_custkey % 7 = 0"))
    old = table.read("before").select("c_custkey", F.lit("before").alias("version"), "c_name")
    return old.union(table.read().select("c_custkey", F.lit("last").alias("version"), "c_name"))


add("bucket_table", _bucketed, "WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'renamed' ELSE c_name END AS c_name FROM customer) SELECT c_custkey, 'before' AS version, c_name FROM r UNION ALL SELECT c_custkey, 'last', c_name FROM r WHERE c_custkey % 7 <> 0")


def _compacted(t: Tables) -> DataFrame:
    source, out = shared_path(t.spark, "many"), shared_path(t.spark, "few")
    t.customer.repartition(12).write.parquet(source)
    return tables.compact_files(t.spark, source, out, 2).select("stage", "files", "rows")


add("compact_files", _compacted, "SELECT s.stage, s.files, (SELECT count(*) FROM customer) AS rows FROM (VALUES ('before', 12), ('after', 2)) s(stage, files)")


# rule files, one for each part's size

_SIGMA_FILE = "concat('title: rule ', p_size, '\nid: id-', p_size, '\nlevel: high\nlogsource:\n  product: windows\n')"


def _sigma_files(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") % 6 == 0, "- only a list").otherwise(F.expr(_SIGMA_FILE))
    rows = t.part.select("p_size").distinct().select("p_size", text.alias("value"))
    base = _files(t, "sigma", rows, "p_size")
    copies = shared_path(t.spark, "sigma-yml")
    # the text sink names files .txt; rules are told by their suffix
    fs = t.spark._jvm.org.apache.hadoop.fs
    root = fs.Path(base)
    system = root.getFileSystem(t.spark._jsc.hadoopConfiguration())
    for folder in system.listStatus(root):
        if folder.isDirectory():
            target = fs.Path(f"{copies}/{folder.getPath().getName()}")
            system.mkdirs(target)
            for k, file in enumerate(f for f in system.listStatus(folder.getPath()) if f.getPath().getName().endswith(".txt")):
                system.rename(file.getPath(), fs.Path(target, f"rule{k}.yml"))
    got = tables.read_sigma_rules(t.spark, copies)
    return got.select(F.regexp_extract("path", r"p_size=(\d+)", 1).cast("int").alias("p_size"), F.get_json_object("document", "$.title").alias("title"), F.get_json_object("document", "$.logsource.product").alias("product"), F.col("error").isNull().alias("good"))


add("read_sigma_rules", _sigma_files, "SELECT DISTINCT p_size, CASE WHEN p_size % 6 > 0 THEN 'rule ' || p_size END AS title, CASE WHEN p_size % 6 > 0 THEN 'windows' END AS product, p_size % 6 > 0 AS good FROM part")


def _yara_files(t: Tables) -> DataFrame:
    """A file of rules for each size of part: a rule per brand, private where the size is even."""
    rule = F.concat(F.when(F.col("p_size") % 2 == 0, "private ").otherwise(""), F.lit("rule r"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, " : apt t1059").otherwise(""), F.lit(' {\n  meta:\n    author = "'), "p_brand", F.lit('"\n    version = "1.0"\n  strings:\n    $a = "x"\n  condition:\n    $a\n}\n'))
    path = _files(t, "yara", t.part.select("p_size", rule.alias("value")), "p_size")
    system = t.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for folder in system.listStatus(t.spark._jvm.org.apache.hadoop.fs.Path(path)):
        for file in system.listStatus(folder.getPath()) if folder.isDirectory() else ():
            old = file.getPath()
            if old.getName().endswith(".txt"):
                system.rename(old, t.spark._jvm.org.apache.hadoop.fs.Path(old.getParent(), old.getName()[:-4] + ".yar"))
    rules = tables.read_yara_rules(t.spark, path)
    return rules.select("name", F.array_join("tags", ",").alias("tags"), F.col("meta")["author"].alias("author"), F.col("meta")["version"].alias("version"), F.regexp_extract("path", r"p_size=(\d+)", 1).cast("int").alias("p_size"))


add("read_yara_rules", _yara_files, "SELECT 'r' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'apt,t1059' ELSE '' END AS tags, p_brand AS author, '1.0' AS version, p_size FROM part")

# streams: each runs over all there is and stops


def _stream(t: Tables, rows: DataFrame) -> DataFrame:
    path = shared_path(t.spark, "stream-in")
    rows.write.parquet(path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


def _drained(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What ``stream`` writes in all; in update mode the last batch's rows per key come last, and here there is one batch."""
    out, state = shared_path(t.spark, "stream-out"), shared_path(t.spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    writer = writer.format("parquet").option("path", out) if mode == "append" else writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    writer.start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def _timed(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", "event_type", F.col("value").alias("duration_ms"))


def _ingest(t: Tables) -> str:
    out, state = shared_path(t.spark, "ingested"), shared_path(t.spark, "ingest-state")
    jobs.stream_ingest(_stream(t, t.notes), out, state).trigger(availableNow=True).start().awaitTermination()
    return out


def _enriched(t: Tables) -> DataFrame:
    """Causal edges by the second query, over the notes that the first one wrote."""
    notes, out, state = f"{_ingest(t)}/notes", shared_path(t.spark, "enriched"), shared_path(t.spark, "enrich-state")
    triple = F.format_string('[["apt%d", "uses", "mimikatz"]]', F.col("importance")).alias("json")
    stream = t.spark.readStream.schema(t.spark.read.parquet(notes).schema).parquet(notes)
    jobs.stream_enrich(stream, lambda batch: batch.select("note_id", triple), out, state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("note_id", "from_value", "relation", "to_value")


add("stream_ingest", lambda t: t.spark.read.parquet(f"{_ingest(t)}/entity_index").select("entity_type", "entity_value", "note_id").distinct(), f"{INDEX} SELECT entity_type, entity_value, note_id FROM entity_index")
add("stream_ingest_superseded", lambda t: t.spark.read.parquet(f"{_ingest(t)}/superseded").select("note_id", "superseded_by"))
add("stream_enrich", _enriched, f"{NOTES} SELECT note_id, 'apt' || importance AS from_value, 'uses' AS relation, 'mimikatz' AS to_value FROM notes WHERE domain IN ('cti', 'incident', 'threat_intel') OR length(content_raw) > 200")
add("stream_dedupe", lambda t: _drained(t, jobs.stream_dedupe(_stream(t, _timed(t).union(_timed(t))), ["event_id"])).select("event_id", "event_type"), "SELECT event_id, event_type FROM events")
add("stream_rule_matches", lambda t: _drained(t, jobs.stream_rule_matches(_stream(t, t.events.select((F.col("event_id") % 25).cast("int").alias("rule_id"), "event_id", "ts").union(t.events.select((F.col("event_id") % 25).cast("int"), "event_id", "ts"))), t.nation.select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("title"), F.lit("high").alias("level")))).select("rule_id", "event_id", "title", "level"), "SELECT n_nationkey AS rule_id, event_id, n_name AS title, 'high' AS level FROM events JOIN nation ON n_nationkey = event_id % 25")
add("stream_telemetry", lambda t: _drained(t, jobs.stream_telemetry(_stream(t, _timed(t)), "1 hour", "1 hour")).select("start", "event_type", "n", F.round("mean_ms", 6).alias("mean_ms")), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _tailed(t: Tables) -> DataFrame:
    """Events as files of JSON lines in the shared folder, tailed."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level")
    stream = read_log_stream(t.spark, _lines(t, "logs", t.events.select(_json("event_id", level))) + "/*.txt")
    return _drained(t, jobs.stream_log_tail(stream, "ERROR")).select(F.get_json_object("line", "$.event_id").cast("long").alias("event_id"), "level")


add("stream_log_tail", _tailed, "SELECT event_id, 'ERROR' AS level FROM events WHERE event_type = 'error'")


def _match_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each event twice as a match of a rule, and the rules."""
    one = t.events.select((F.col("event_id") % 25).cast("int").alias("rule_id"), "event_id", "ts")
    return one.union(one), t.nation.select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("title"), F.lit("high").alias("level"))


def _match_notes(t: Tables) -> DataFrame:
    matches, known = _match_rows(t)
    out, state = shared_path(t.spark, "matches"), shared_path(t.spark, "match-state")
    jobs.stream_rule_notes(_stream(t, matches), known, out, state).trigger(availableNow=True).start().awaitTermination()
    edges = t.spark.read.parquet(f"{out}/edges").select(F.expr("substring(from_id, 6)").alias("note_id"), "to_id", "relationship")
    return t.spark.read.parquet(f"{out}/notes").select("note_id", "content_raw").join(edges, "note_id")


add("stream_rule_notes", _match_notes, "SELECT 'match_' || n_nationkey || '_' || event_id AS note_id, 'Rule ' || n_name || ' (high) matched event ' || event_id AS content_raw, 'rule:' || n_nationkey AS to_id, 'MATCHED_BY' AS relationship FROM events JOIN nation ON n_nationkey = event_id % 25")
def _accesses(t: Tables) -> DataFrame:
    hits = _stream(t, t.events.select(F.concat(F.lit("note_"), "user_id").alias("note_id"), "ts"))
    updates = _drained(t, jobs.stream_access_counts(hits, "1 day"), "update")
    return jobs.merge_access_counts(updates.limit(0).select("note_id", "access_count", "last_accessed"), updates)


add("stream_access_counts", _accesses, "SELECT 'note_' || user_id AS note_id, count(*) AS access_count, max(ts) AS last_accessed FROM events GROUP BY 1")
_SESSIONS = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"
add("stream_session_activity", lambda t: _drained(t, jobs.stream_session_activity(_stream(t, t.events.select("ts", F.col("user_id").cast("string").alias("actor"))), "1 hour")), f'{_SESSIONS} SELECT CAST(user_id AS VARCHAR) AS actor, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR')


def _shifts(t: Tables) -> DataFrame:
    rows = shift_rows(t).withColumn("at", F.unix_timestamp(F.col("created_at").cast("timestamp")).cast("double"))
    return _drained(t, jobs.stream_shift(_stream(t, rows), idle=IDLE, report=True))


add("stream_shift", _shifts)
