"""Entity extraction from note text, as native expressions over whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import ALIASES, CASELESS, CODE_CONTEXT, HASH_TYPES, NAME_STOPWORDS, NEEDLES, PATTERNS, STARTS


def pattern(kind: str) -> str:
    """The pattern of ``kind`` behind what its matches begin with."""
    return ("(?i)" if kind in CASELESS else "") + STARTS.get(kind, "") + PATTERNS[kind]


def long_hex(text: Column) -> Column:
    """Whether ``text`` has as many hexadecimal digits in a row as the shortest hash: few texts do."""
    return text.rlike("[a-fA-F0-9]{32}")


def entity_values(text: Column, kind: str, hexes: Column | None = None) -> Column:
    """Distinct values of one entity type in ``text``, lower case, blanks as hyphens; ``hexes`` is ``long_hex`` if it is known."""
    group = 1 if kind == "person" else 0
    found = F.regexp_extract_all(text, F.lit(pattern(kind)), F.lit(group))
    values = F.array_distinct(F.transform(found, lambda v: F.replace(F.lower(v), F.lit(" "), F.lit("-"))))
    if kind == "person":
        values = F.filter(values, lambda v: ~v.isin(*NAME_STOPWORDS))
    if kind in HASH_TYPES:
        return F.when(long_hex(text) if hexes is None else hexes, F.array_except(values, code_hashes(text))).when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(text.contains(NEEDLES[kind]), values).when(text.isNotNull(), F.array().cast("array<string>")) if kind in NEEDLES else values


def code_hashes(text: Column) -> Column:
    """Hex strings on lines that come from code or version control."""
    lines = F.filter(F.split(text, r"\R"), lambda line: line.rlike("(?i)" + CODE_CONTEXT))
    return F.array_distinct(F.flatten(F.transform(lines, lambda line: F.transform(F.regexp_extract_all(line, F.lit(r"\b[a-fA-F0-9]{32,64}\b"), F.lit(0)), F.lower))))


def extract_type(notes: DataFrame, kind: str, text: str = "content_raw", key: str = "note_id") -> DataFrame:
    """(key, entity_value) of one entity type."""
    return notes.select(key, F.explode(entity_values(F.col(text), kind)).alias("entity_value"))


def extract_all_long(notes: DataFrame, text: str = "content_raw", key: str = "note_id", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """(key, entity_type, entity_value) of every type in one pass over the text."""
    notes = notes.select(key, text, long_hex(F.col(text)).alias("long_hex"))
    found = F.create_map(*[x for k in kinds for x in (F.lit(k), entity_values(F.col(text), k, F.col("long_hex")))])
    return notes.select(key, F.explode(found).alias("entity_type", "v")).select(key, "entity_type", F.explode("v").alias("entity_value"))


def merge_ner(entities: DataFrame, completions: DataFrame) -> DataFrame:
    """``entities`` and those of model completions (note_id, json): six list-valued keys, trimmed, longer than one character."""
    schema = "person array<string>, location array<string>, organization array<string>, event array<string>, activity array<string>, temporal array<string>"
    parsed = completions.select("note_id", F.from_json("json", schema).alias("j"))
    kinds = ("person", "location", "organization", "event", "activity", "temporal")
    lists = F.create_map(*[x for k in kinds for x in (F.lit(k), F.coalesce(F.col(f"j.{k}"), F.array().cast("array<string>")))])
    new = parsed.select("note_id", F.explode(lists).alias("entity_type", "v")).select("note_id", "entity_type", F.explode("v").alias("v"))
    new = new.select("note_id", "entity_type", F.lower(F.trim("v")).alias("entity_value")).where(F.length("entity_value") > 1)
    return entities.select("note_id", "entity_type", "entity_value").union(new).distinct()


def resolve_alias(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``canonical``: the alias table's name for (type, value with blanks for hyphens), else the lower-cased value."""
    spark = entities.sparkSession
    table = aliases if aliases is not None else spark.createDataFrame(ALIASES, "entity_type string, alias string, canonical string")
    keyed = entities.withColumn("alias", F.replace(F.lower("entity_value"), F.lit("-"), F.lit(" ")))
    joined = keyed.join(table.select("entity_type", "alias", F.col("canonical").alias("named")), ["entity_type", "alias"], "left")
    return joined.select(*entities.columns, F.coalesce("named", F.lower("entity_value")).alias("canonical"))


def alias_overlay(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """``builtin`` aliases without the types that ``user`` names, and all of ``user``."""
    return builtin.join(user.select("entity_type").distinct(), "entity_type", "left_anti").select(*builtin.columns).union(user.select(*builtin.columns))


def alias_match(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``same_actor`` to (predicted, expected): equal, one inside the other, or names of one canonical actor."""
    names = aliases.select("canonical", "alias").union(aliases.select("canonical", F.col("canonical").alias("alias"))).distinct()
    p = pairs.withColumn("p", F.lower(F.trim("predicted"))).withColumn("e", F.lower(F.trim("expected")))
    p = p.join(names.select(F.col("alias").alias("p"), F.col("canonical").alias("pc")), "p", "left").join(names.select(F.col("alias").alias("e"), F.col("canonical").alias("ec")), "e", "left")
    same = (F.col("p") == F.col("e")) | F.col("p").contains(F.col("e")) | F.col("e").contains(F.col("p")) | F.coalesce(F.col("pc") == F.col("ec"), F.lit(False))
    return p.select(*pairs.columns, same.alias("same_actor")).distinct()


def infer_entity_type(value: Column, hint: Column | None = None) -> Column:
    """Type of an entity by its text; a conversational hint wins."""
    v = F.lower(value)
    # fixed values: names and words that tell a type
    group = v.rlike(r"\b(apt|unc|ta|fin)\d+\b|lazarus|sandworm|fancy bear|cozy bear|volt typhoon")
    rule = (
        F.when(v.contains("cve-"), "cve").when(group, "intrusion_set")
        .when(v.rlike("north korea|(russian|iranian|chinese) threat actor"), "threat_actor")
        .when(v.rlike("cobalt strike|metasploit|mimikatz|bloodhound|dropbear|empire"), "tool")
        .when(v.rlike("operation|campaign"), "campaign").otherwise("entity")
    )
    if hint is None:
        return rule
    return F.when(hint.isin("person", "location", "organization", "event", "activity", "temporal"), hint).otherwise(rule)


def technique_parent(notes: DataFrame, text: str = "content_raw") -> DataFrame:
    """Distinct (note_id, technique): technique ids rolled up to their parents."""
    ids = F.regexp_extract_all(F.col(text), F.lit(r"T\d{4}(?:\.\d{3})?"), F.lit(0))
    return notes.select("note_id", F.explode(F.array_distinct(F.transform(ids, lambda x: F.split_part(x, F.lit("."), F.lit(1))))).alias("technique"))


# fixed values: actor names in the order they are tried, case-blind
ACTOR_PATTERNS = (
    r"\bAPT\s*\d+\b", r"\bLazarus(?:\s+Group)?\b", r"\bSandworm\b", r"\bFancy\s+Bear\b", r"\bCozy\s+Bear\b", r"\bVolt\s+Typhoon\b", r"\bTurla\b",
    r"\bKimsuky\b", r"\bCharming\s+Kitten\b", r"\bMuddyWater\b", r"\bOceanLotus\b", r"\bDarkHotel\b", r"\bEquation\s+Group\b", r"\bUNC\d+\b",
)
ACTOR_PHRASE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"


def primary_actor(notes: DataFrame, text: str = "content_raw") -> DataFrame:
    """(note_id, primary_actor): the first match of the first pattern that has one, else the first phrase of two or more
    capitalised words, else an empty text."""
    patterns = [*(f"(?i){p}" for p in ACTOR_PATTERNS), ACTOR_PHRASE]
    return notes.select("note_id", F.coalesce(*[F.nullif(F.regexp_extract(F.col(text), p, 0), F.lit("")) for p in patterns], F.lit("")).alias("primary_actor"))


def hunt_iocs(notes: DataFrame, benign: DataFrame, text: str = "content_raw") -> DataFrame:
    """Distinct (note_id, entity_type, entity_value) of network indicators, without the domains of ``benign`` (domain)."""
    found = extract_all_long(notes, text, kinds=("ipv4", "domain", "url", "md5", "sha1", "sha256", "email"))
    return found.join(benign.select(F.col("domain").alias("entity_value")), "entity_value", "left_anti").select("note_id", "entity_type", "entity_value")

