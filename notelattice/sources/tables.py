"""Readers of note logs, rule trees and bundles, and maintenance of Parquet tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bundles import read_objects


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key by ``at``; of ties the greatest row."""
    cols = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max(F.struct(F.col(at).alias("__at"), *[F.col(c).alias(c) for c in cols])).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in cols]).select(*rows.columns)


def read_notes_jsonl(spark: SparkSession, path: str, schema: str, key: str = "note_id", at: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """Last line of each note, and the lines that can't be parsed."""
    rows = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    good = rows.where(F.col("_corrupt").isNull() & F.col(key).isNotNull()).drop("_corrupt")
    return latest(good, key, at), rows.where(F.col("_corrupt").isNotNull()).select("_corrupt")


def read_telemetry(spark: SparkSession, path: str, schema: str, at: str = "timestamp") -> DataFrame:
    """All daily event files; corrupt lines dropped, ``event_date`` from the time in seconds."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("event_date", F.to_date(F.timestamp_seconds(at)))


def load_entity_index_map(docs: DataFrame, column: str = "value") -> DataFrame:
    """(entity_type, entity_value, note_id) of documents {type: {value: [note]}}."""
    m = docs.select(F.explode(F.from_json(column, "map<string,map<string,array<string>>>")).alias("entity_type", "m"))
    return m.select("entity_type", F.explode("m").alias("entity_value", "ns")).select("entity_type", "entity_value", F.explode("ns").alias("note_id"))


STIX_OBJECTS = (
    "type string, id string, name string, description string, created string, revoked boolean, x_mitre_deprecated boolean, aliases array<string>, relationship_type string, "
    "source_ref string, target_ref string, object_refs array<string>, external_references array<struct<source_name:string,external_id:string>>"
)


def read_stix_objects(spark: SparkSession, path: str) -> DataFrame:
    """Every object of the bundle files below ``path``, one row each; a large file is read in splits."""
    return read_objects(spark, path, STIX_OBJECTS)


def read_stix_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(technique_id, name) of attack patterns in bundle files: neither revoked nor deprecated, no sub-techniques."""
    o = read_stix_objects(spark, path).where("type = 'attack-pattern'")
    live = o.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    first = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    rows = live.select(first.alias("technique_id"), "name").where(F.col("technique_id").isNotNull() & ~F.col("technique_id").contains("."))
    return rows.groupBy("technique_id").agg(F.min("name").alias("name"))


def stix_extract_reports(objects: DataFrame) -> DataFrame:
    """(id, name, description, created, kind, entity): named entities that a report's relations point to; a report without
    any has one row with nulls, one without a name or a description none. Descriptions are cut at 3000 characters."""
    kinds = ("malware", "intrusion-set", "attack-pattern", "vulnerability")
    ends = objects.where(F.col("type").isin(*kinds) & (F.coalesce("name", F.lit("")) != "")).select(F.col("id").alias("to_id"), F.col("type").alias("kind"), F.col("name").alias("entity"))
    rels = objects.where("type = 'relationship' AND relationship_type IN ('related-to', 'uses', 'targets', 'indicates')").select(F.col("source_ref").alias("id"), F.col("target_ref").alias("to_id"))
    named = rels.join(ends, "to_id").select("id", "kind", "entity").distinct()
    reports = objects.where("type = 'report' AND coalesce(name, '') <> '' AND coalesce(description, '') <> ''").select("id", "name", F.substring("description", 1, 3000).alias("description"), "created")
    return reports.join(named, "id", "left").select("id", "name", "description", "created", "kind", "entity")


def stix_extract_actor_tools(objects: DataFrame) -> DataFrame:
    """(id, name, aliases, kind, used): malware and tools that an intrusion set uses; a set without any has one row with nulls."""
    actors = objects.where("type = 'intrusion-set' AND coalesce(name, '') <> ''").select("id", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    used = objects.where("type IN ('malware', 'tool')").select(F.col("id").alias("to_id"), F.col("type").alias("kind"), F.col("name").alias("used"))
    rels = objects.where("type = 'relationship' AND relationship_type = 'uses'").select(F.col("source_ref").alias("id"), F.col("target_ref").alias("to_id"))
    return actors.join(rels.join(used, "to_id"), "id", "left").select("id", "name", "aliases", "kind", "used")


def stix_technique_ids(objects: DataFrame) -> DataFrame:
    """(id, name, description, mitre_id) of attack patterns: the first reference of one of the matrices, else an empty text."""
    refs = F.filter("external_references", lambda r: r["source_name"].isin("mitre-attack", "mitre-mobile-attack", "mitre-ics-attack"))
    first = F.coalesce(F.get(refs, F.lit(0))["external_id"], F.lit(""))
    return objects.where("type = 'attack-pattern'").select("id", "name", F.substring("description", 1, 500).alias("description"), first.alias("mitre_id"))


def read_kg_log(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of JSON-lines logs, each in its last version, and (skipped) the number of edge lines left out.

    Legacy keys of edges are renamed; lines that aren't JSON, or lack an id, an end or a relation, are left out. Of
    versions with one id the last by ``updated_at`` counts.
    """
    bad = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    node_rows = spark.read.schema("node_id string, entity_type string, entity_value string, updated_at string, _corrupt string").options(**bad).json(nodes)
    last_nodes = latest(node_rows.where("_corrupt IS NULL AND node_id IS NOT NULL").drop("_corrupt"), "node_id", "updated_at")
    names = ("edge_id", "from_id", "to_id", "relationship", "source_id", "target_id", "relation_type", "updated_at")
    lines = spark.read.text(edges).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", ", ".join(f"{n} string" for n in names)).alias("e")).select("e.*")
    pick = lambda new, old: F.coalesce(new, old).alias(new)
    rows = parsed.select("edge_id", pick("from_id", "source_id"), pick("to_id", "target_id"), pick("relationship", "relation_type"), "updated_at")
    whole = F.col("edge_id").isNotNull() & F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & F.col("relationship").isNotNull()
    return last_nodes, latest(rows.where(whole), "edge_id", "updated_at"), rows.agg(F.count_if(~whole).alias("skipped"))


def read_sigma_rules(spark: SparkSession, path: str, limit: int = 1 << 20) -> DataFrame:
    """(path, document as JSON, error) of .yml and .yaml files below ``path``; a bad or too large file is a row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.ya?ml$")).select("path", "length", F.when(F.col("length") <= limit, F.col("content")).alias("content"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    if r.content is None:
                        raise ValueError(f"{r.length} bytes are too many")
                    doc = yaml.safe_load(r.content)
                    if not isinstance(doc, dict):
                        raise ValueError("no mapping")
                    out.append((r.path, json.dumps(doc, default=str, sort_keys=True), None))
                except Exception as e:  # noqa: BLE001  one bad file is a row, not the end
                    out.append((r.path, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["path", "document", "error"])

    return files.mapInPandas(parse, "path string, document string, error string")


def read_yara_rules(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, tags, meta, raw): a row per rule of .yar and .yara files below ``path``."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.lower("path").rlike(r"\.yara?$"))
    rules = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^\s*(?:private\s+|global\s+)*rule\s+\w+.*?^\}"), F.lit(0))).alias("raw"))
    head = F.regexp_extract("raw", r"rule\s+(\w+)\s*(?::\s*([^{]*))?\{", 1)
    tags = F.filter(F.split(F.trim(F.regexp_extract("raw", r"rule\s+(\w+)\s*(?::\s*([^{]*))?\{", 2)), r"\s+"), lambda x: x != "")
    block = F.regexp_extract("raw", r"(?s)meta:(.*?)(?:strings:|condition:)", 1)
    pairs = F.transform(F.regexp_extract_all(block, F.lit(r'(?m)^\s*\w+\s*=\s*(?:"(?:[^"\\]|\\.)*"|\S+)'), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, r"(\w+)\s*=", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^=]*=\s*", ""), '^"|"$', "")).alias("v")))
    meta = F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda a, p: F.array_append(F.filter(a, lambda x: x["k"] != p["k"]), p)))
    return rules.select("path", head.alias("name"), tags.alias("tags"), meta.alias("meta"), F.trim("raw").alias("raw"))


def read_hunt_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(hunt_id, learn, observe, check, keep) of hunt reports; files without an id are dropped."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    part = lambda name: F.btrim(F.regexp_extract("value", rf"(?ms)^##[ \t]*{name}[ \t]*$(.*?)(?=^##\s|\Z)", 1), F.lit(" \t\r\n")).alias(name.lower())
    return files.select(F.regexp_extract("value", r"(?m)^hunt_id:\s*(\S+)", 1).alias("hunt_id"), *[part(n) for n in ("LEARN", "OBSERVE", "CHECK", "KEEP")]).where("hunt_id <> ''")


def flatten_conversations(spark: SparkSession, path: str, many: bool = False) -> DataFrame:
    """(sample_id, session, turn, speaker, text) of multi-session dialogue documents: one per file, or with ``many`` one per line."""
    docs = spark.read.schema("sample_id string, sessions map<string,array<struct<speaker:string,text:string>>>").option("multiLine", not many).json(path)
    return docs.select("sample_id", F.explode("sessions").alias("session", "turns")).select("sample_id", "session", F.posexplode("turns").alias("turn", "t")).select("sample_id", "session", "turn", "t.speaker", "t.text")


def upsert(table: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """``table`` with ``rows`` inserted or, by key, replaced where they are later."""
    return latest(table.unionByName(rows), key, at)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def replace_column(table: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``table`` with ``column`` replaced where ``new`` (key, column) has the key."""
    j = table.join(new.select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit")), key, "left")
    return j.withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).select(*table.columns)


def sizes(named: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables."""
    out = None
    for name, df in named.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


def write_vector_table(rows: DataFrame, path: str, dim: int) -> DataFrame:
    """Write (id, domain, vector, content) by domain, missing vectors as zeros and content cut at 500; returns rejects."""
    good = F.col("vector").isNull() | (F.size("vector") == dim)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    rows.where(good).select("id", "domain", F.coalesce("vector", zeros).alias("vector"), F.substring("content", 1, 500).alias("content")).write.partitionBy("domain").mode("overwrite").parquet(path)
    return rows.where(~good)


def snapshot_export(table: DataFrame, path: str, label: str) -> str:
    out = f"{path.rstrip('/')}/snapshot={label}"
    table.write.parquet(out)
    return out


def compact_files(spark: SparkSession, source: str, out: str, files: int) -> DataFrame:
    """Rewrite ``source`` as ``files`` files in ``out``; returns (stage, files, bytes, rows) before and after."""
    spark.read.parquet(source).repartition(files).write.parquet(out)

    def stats(path: str, stage: str) -> DataFrame:
        per = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).agg(F.count("*").alias("n"))
        return per.agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.sum("n").alias("rows")).select(F.lit(stage).alias("stage"), "files", "bytes", "rows")

    return stats(source, "before").union(stats(out, "after"))
