"""Checks of typed entities and relations against a table of types."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut

# fixed values: required properties of entity types, ends of relation types, and relations that must not form cycles
ENTITY_TYPES = (
    ("Person", ["name"]), ("Organization", ["name"]), ("Project", ["name", "status"]), ("Task", ["title", "status"]), ("Goal", ["description"]),
    ("Event", ["title", "start"]), ("Location", ["name"]), ("Document", ["title"]), ("Note", ["content"]), ("Account", ["service", "username"]),
    ("Device", ["name"]), ("IntrusionSet", ["name"]), ("ThreatActor", ["name"]), ("Vulnerability", ["cve_id"]), ("Malware", ["name"]),
    ("Campaign", ["name"]), ("Incident", ["title", "status"]), ("AttackPattern", ["technique_id"]),
    ("DetectionRule", ["rule_id", "title", "source_format", "content_sha256"]), ("SigmaRule", ["rule_id", "title", "source_format", "content_sha256"]),
    ("YaraRule", ["rule_id", "title", "source_format", "content_sha256"]), ("SigmaTag", ["namespace", "name"]), ("YaraTag", ["namespace", "name"]),
    ("LogSource", []), ("IPv4Address", ["value"]), ("DomainName", ["value"]), ("URL", ["value"]), ("FileHash", ["value", "hash_type"]),
    ("EmailAddress", ["value"]), ("Action", ["type", "timestamp"]), ("Policy", ["scope", "rule"]),
)
_ANY = [name for name, _ in ENTITY_TYPES]
_RULES = ["DetectionRule", "SigmaRule", "YaraRule"]
RELATION_TYPES = (
    ("has_owner", ["Project", "Task", "Event", "Document"], ["Person", "Organization"]), ("has_assignee", ["Task", "Incident"], ["Person"]),
    ("has_task", ["Project"], ["Task"]), ("blocks", ["Task"], ["Task"]), ("related_to", _ANY, _ANY), ("part_of", ["Task", "Document", "Event"], ["Project"]),
    ("attributed_to", ["Incident", "Campaign", "Malware", "IntrusionSet", *_RULES], ["ThreatActor", "IntrusionSet"]), ("uses", ["IntrusionSet"], ["Malware"]),
    ("uses_technique", ["ThreatActor", "Campaign", "IntrusionSet"], ["AttackPattern"]), ("uses_tool", ["ThreatActor", "Campaign"], ["Malware", "Tool"]),
    ("exploits", ["ThreatActor", "Campaign", "Malware"], ["Vulnerability"]), ("implements", ["Malware"], ["AttackPattern"]),
    ("targets", ["ThreatActor", "Campaign", "Malware"], ["Organization", "Location", "Device"]),
    ("superseded_by", ["Note", "Document", "Policy", *_RULES], ["Note", "Document", "Policy", *_RULES]), ("detects", _RULES, ["AttackPattern"]),
    ("references_cve", _RULES, ["Vulnerability"]), ("tagged_with", _RULES, ["SigmaTag", "YaraTag"]), ("applies_to", ["SigmaRule", "DetectionRule"], ["LogSource"]),
)
ACYCLIC = ("blocks", "superseded_by")
TYPE_SCHEMA = "type string, required array<string>, forbidden array<string>, enums map<string,array<string>>, ordered boolean"


def entity_types(spark) -> DataFrame:
    """The built-in types (TYPE_SCHEMA); only a user's types forbid properties, list values or order start and end."""
    return spark.createDataFrame([(name, required, [], {}, False) for name, required in ENTITY_TYPES], TYPE_SCHEMA)


def relation_types(spark) -> DataFrame:
    return spark.createDataFrame(RELATION_TYPES, "rel string, from_types array<string>, to_types array<string>")


def schema_overlay(builtin: DataFrame, user: DataFrame, key: str) -> DataFrame:
    """``builtin`` types with those that ``user`` defines replaced or added."""
    return builtin.join(user.select(key), key, "left_anti").select(*builtin.columns).union(user.select(*builtin.columns))


def validate_entities(entities: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(id, missing, forbidden, invalid, ends_early, valid) of entities (id, type, properties map) by their types: required
    properties absent or empty, forbidden ones present, values beyond a list, an end before the start; unknown types pass."""
    types = entity_types(entities.sparkSession) if types is None else types
    rows = entities.join(types, "type", "left")
    none = F.array().cast("array<string>")
    has = lambda f: F.map_contains_key("properties", f)
    missing = F.filter(F.coalesce("required", none), lambda f: F.coalesce(F.col("properties")[f], F.lit("")) == "")
    forbidden = F.filter(F.coalesce("forbidden", none), has)
    invalid = F.filter(F.coalesce(F.map_keys("enums"), none), lambda f: has(f) & ~F.coalesce(F.array_contains(F.col("enums")[f], F.col("properties")[f]), F.lit(False)))
    early = F.coalesce(F.col("ordered") & (F.col("properties")["end"] < F.col("properties")["start"]), F.lit(False))
    named = [F.array_join(x, ",").alias(n) for n, x in (("missing", missing), ("forbidden", forbidden), ("invalid", invalid))]
    return rows.select("id", *named, early.alias("ends_early"), ((F.size(missing) + F.size(forbidden) + F.size(invalid) == 0) & ~early).alias("valid"))


def validate_relations(relations: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Adds ``valid``: both end types allowed by the relation; unknown relations pass."""
    types = relation_types(relations.sparkSession) if types is None else types
    j = relations.join(types, "rel", "left")
    ok = F.col("from_types").isNull() | (F.array_contains("from_types", F.col("from_type")) & F.array_contains("to_types", F.col("to_type")))
    return j.select(*relations.columns, ok.alias("valid"))


def referential_check(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with an end that no entity has, and which."""
    ids = entities.select("id").distinct()
    j = relations.join(ids.select(F.col("id").alias("from_id"), F.lit(True).alias("f")), "from_id", "left").join(ids.select(F.col("id").alias("to_id"), F.lit(True).alias("t")), "to_id", "left")
    return j.where("f IS NULL OR t IS NULL").select("from_id", "rel", "to_id", F.col("f").isNull().alias("no_from"), F.col("t").isNull().alias("no_to"))


def strong_components(links: DataFrame) -> DataFrame:
    """(node, component): nodes of ``links`` (a, b) that lie on a cycle of more than one node, and the greatest node of theirs.

    Nodes without a way in or out are trimmed. Then each node takes the greatest node that reaches it as its colour (colours of
    colours are taken along, so long ways halve); what reaches a colour's own node within the colour is a component. The next
    round turns the links around. All tables are as large as the links at most.
    """
    live, out = cut(links.select("a", "b").where("a <> b").distinct()), []
    while True:
        n = live.count()
        while n:
            live = cut(live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            n, before = live.count(), n
            if n == before:
                break
        if not n:
            break
        colours = cut(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("colour", F.col("node")))
        while True:
            come = live.join(colours.select(F.col("node").alias("a"), "colour"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("come"))
            step = colours.join(come, "node", "left").select("node", F.col("colour").alias("old"), F.greatest("colour", "come").alias("via"))
            far = colours.select(F.col("node").alias("via"), F.col("colour").alias("far"))
            new = cut(step.join(far, "via", "left").select("node", "old", F.greatest("via", "far").alias("colour")))
            colours = new.select("node", "colour")
            if new.where("old <> colour").isEmpty():
                break
        inside = live.join(colours.select(F.col("node").alias("a"), "colour"), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("c")), "b").where("colour = c").select("a", "b", "colour")
        inside = cut(inside)
        reached = frontier = cut(colours.where("node = colour"))
        while not frontier.isEmpty():
            back = inside.join(frontier.select(F.col("node").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct()
            frontier = cut(back.join(reached, ["node", "colour"], "left_anti"))
            reached = cut(reached.union(frontier))
        sizes = reached.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        out.append(reached.join(sizes, "colour").select("node", F.col("colour").alias("component")))
        gone = reached.select("node")
        live = cut(live.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not out:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def _reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): the nodes of ``starts`` (node) and all that ``links`` (a, b) lead to from any of them."""
    seen = frontier = cut(starts.select("node").distinct())
    while not frontier.isEmpty():
        step = links.join(frontier.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        seen = seen.union(frontier)
    return cut(seen)


def acyclic_check(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(from_id, to_id) of ``new`` relations that would close a cycle over ``existing`` ones of the same relation, however long.

    Each new relation is held against the existing ones alone. What counts of those lies on ways from the ends of new
    relations to their beginnings, which two searches from all of them at once tell in tables no larger than the links. Ends in
    one strong component are connected both ways; what is left is searched for one by one, within what counts.
    """
    links = cut(existing.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    asked = cut(new.select("from_id", "to_id").where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct())
    bad, able = asked.where("from_id = to_id"), asked.where("from_id <> to_id")
    ahead = _reached(links, able.select(F.col("to_id").alias("node")))
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b")).join(ahead.withColumnRenamed("node", "a"), "a", "left_semi").join(ahead.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    both = _reached(turned, able.select(F.col("from_id").alias("node")).join(ahead, "node", "left_semi"))
    near = cut(turned.join(both.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("a"), F.col("a").alias("b")))
    able = cut(able.join(both.withColumnRenamed("node", "from_id"), "from_id", "left_semi").join(both.withColumnRenamed("node", "to_id"), "to_id", "left_semi").select("from_id", "to_id"))
    if able.isEmpty():
        return bad
    parts = cut(strong_components(near))
    ends = [parts.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}")) for c in ("from_id", "to_id")]
    sure = cut(able.join(ends[0], "from_id").join(ends[1], "to_id").where("in_from_id = in_to_id").select("from_id", "to_id"))
    frontier = cut(able.join(sure, ["from_id", "to_id"], "left_anti").withColumn("node", F.col("to_id")))
    bad, seen = bad.union(sure), frontier
    while not frontier.isEmpty():  # ends, as each round reaches nodes not seen before
        step = frontier.join(near, F.col("node") == F.col("a")).select("from_id", "to_id", F.col("b").alias("node")).distinct()
        hit = cut(step.where("node = from_id").select("from_id", "to_id"))
        bad = bad.union(hit)
        frontier = cut(step.join(hit, ["from_id", "to_id"], "left_anti").join(seen, ["from_id", "to_id", "node"], "left_anti"))
        seen = seen.union(frontier)
    return bad.distinct()


def entities_by_type(entities: DataFrame, kind: str) -> DataFrame:
    return entities.where(F.col("type") == kind)


def entities_by_property(entities: DataFrame, name: str, value: str) -> DataFrame:
    return entities.where(F.col("properties")[name] == value)


def related_entities(relations: DataFrame, entities: DataFrame, ids: DataFrame, rel: str | None = None) -> DataFrame:
    """(from_id, rel, to_id, type) out of ``ids`` (id)."""
    rows = relations.where(F.col("rel") == rel) if rel else relations
    return rows.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(entities.select(F.col("id").alias("to_id"), "type"), "to_id").select("from_id", "rel", "to_id", "type")
