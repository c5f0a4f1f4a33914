"""Detection-rule metadata: tags, edges, schema checks and explanations, for Sigma and YARA rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: fields that strict metadata needs, and the form of each field
REQUIRED_FIELDS = ("id", "fingerprint", "version", "modified", "status", "sharing", "source", "author", "description", "category")
FIELD_FORMS = {
    "id": r"^[0-9A-Za-z]{16,}$",
    "fingerprint": r"^[a-fA-F0-9]{40,64}$",
    "version": r"^\d+\.\d+$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "modified": r"^\d{4}-\d{2}-\d{2}$",
    "status": r"^(TESTING|RELEASED|DEPRECATED)",
    "sharing": r"^(TLP:CLEAR|TLP:WHITE|TLP:GREEN|TLP:AMBER)",
    "category": r"^(INFO|EXPLOIT|TECHNIQUE|TOOL|MALWARE)",
    "actor_type": r"^(APT|CRIMEWARE|FIN)",
    "hash": r"^([a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})",
    "mitre_att": r"^(TA|T|M|G|S)\d{4}(\.\d{3})?$",
}
CATEGORY_TOKENS = ("APT", "CRIME", "CRIMEWARE", "EXPL", "HKTL", "MAL", "MALWARE", "PUA", "RAT", "RANSOM", "RANSOMWARE", "SUSP", "VULN", "WEBSHELL")


def rule_id(given: Column, document: Column, prefix: str) -> Column:
    """A rule's own id, else the prefix and 16 hex digits of the document's hash."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(document, 256), 1, 16)))


def sigma_project(rules: DataFrame) -> DataFrame:
    """A row per rule of rules (id, title, level, document as JSON), with the columns of a Sigma rule: those of every
    detection rule, log source, body, type, fields and false positives. Lists the document lacks are empty."""
    get = lambda k: F.get_json_object("document", f"$.{k}")
    strings = lambda k: F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>")).alias(k)
    kind = F.when(get("correlation").isNotNull(), "correlation").when(get("filter").isNotNull(), "filter").otherwise("detection")
    level, status = F.col("level"), get("status")
    return rules.select(
        rule_id(F.col("id"), F.col("document"), "sigma").alias("rule_id"), F.coalesce("title", F.lit("")).alias("title"), F.lit("sigma").alias("source_format"), F.sha2("document", 256).alias("content_sha256"),
        *[get(k).alias(k) for k in ("description", "author", "date", "modified", "license")], strings("references"), strings("tags"), level.alias("level"), status.alias("status"),
        *[get(f"logsource.{k}").alias(f"logsource_{k}") for k in ("product", "service", "category")], level.alias("rule_level"), status.alias("rule_status"),
        F.coalesce(get("detection"), get("correlation")).alias("detection_body"), kind.alias("rule_type"), strings("fields"), strings("falsepositives"),
    )


def sigma_validate(rules: DataFrame) -> DataFrame:
    """(rule_id, errors): dotted paths of missing or wrong parts, by rule type."""
    has = lambda k: F.get_json_object("document", f"$.{k}").isNotNull()
    checks = [
        F.when(F.col("title").isNull() | (F.trim("title") == ""), "title: required"),
        F.when(~has("correlation") & ~has("logsource"), "logsource: required"),
        F.when(~has("correlation") & ~has("detection.condition"), "detection.condition: required"),
        F.when(has("correlation") & ~has("correlation.type"), "correlation.type: required"),
        F.when(F.col("level").isNotNull() & ~F.lower("level").isin("informational", "low", "medium", "high", "critical"), "level: not allowed"),
    ]
    return rules.select(rule_id(F.col("id"), F.col("document"), "sigma").alias("rule_id"), F.array_compact(F.array(*checks)).alias("errors"))


def sigma_tag(tag: Column) -> tuple[Column, Column]:
    """(entity type, value) of a tag; null where it names no entity."""
    space, rest = F.lower(F.split_part(tag, F.lit("."), F.lit(1))), F.trim(F.regexp_replace(tag, r"^[^.]*\.", ""))
    first = F.split_part(F.lower(rest), F.lit("."), F.lit(1))
    attack, cve = space == "attack", (space == "cve") & rest.rlike(r"^\d{4}[.-]\d[\d-]*$")
    kind = F.when(attack & rest.rlike(r"(?i)^t\d{4}(\.\d{3})?$"), "AttackPattern").when(attack & first.rlike(r"^g\d{4}$"), "IntrusionSet").when(attack & first.rlike(r"^s\d{4}$"), "Malware").when(cve, "Vulnerability")
    value = F.when(kind == "AttackPattern", F.upper(rest)).when(kind.isin("IntrusionSet", "Malware"), F.upper(first)).when(kind == "Vulnerability", F.concat(F.lit("CVE-"), F.substring(rest, 1, 4), F.lit("-"), F.regexp_replace(rest, r"^\d{4}[.-]", "")))
    return kind, value


def sigma_tag_resolve(tags: DataFrame) -> DataFrame:
    kind, value = sigma_tag(F.col("tag"))
    return tags.select("rule_id", "tag", kind.alias("entity_type"), value.alias("entity_value"))


def sigma_tag_edges(tags: DataFrame) -> DataFrame:
    """tagged_with for every tag, and a typed edge for tags that name an entity."""
    rows = sigma_tag_resolve(tags)
    rel = F.when(F.col("entity_type") == "AttackPattern", "detects").when(F.col("entity_type") == "Vulnerability", "references_cve").otherwise("attributed_to")
    return rows.select("rule_id", F.lit("tagged_with").alias("rel"), F.lit("SigmaTag").alias("to_type"), F.col("tag").alias("to_value")).union(rows.where("entity_type IS NOT NULL").select("rule_id", rel, "entity_type", "entity_value"))


def sigma_logsource_edges(rules: DataFrame) -> DataFrame:
    facets = rules.select("rule_id", F.expr("stack(3, 'product', product, 'service', service, 'category', category) AS (facet, value)"))
    return facets.where("value IS NOT NULL AND value <> ''").select("rule_id", F.lit("applies_to").alias("rel"), F.concat_ws(":", "facet", "value").alias("to_value"))


def sigma_related_edges(related: DataFrame) -> DataFrame:
    """superseded_by for obsolete relations, else related_to, from (rule_id, other_id, type)."""
    return related.where("other_id IS NOT NULL AND other_id <> ''").select("rule_id", F.when(F.lower("type") == "obsolete", "superseded_by").otherwise("related_to").alias("rel"), F.col("other_id").alias("to_value"))


def sigma_note(rules: DataFrame) -> DataFrame:
    """(source_ref, content): a summary line and the body, referred to by id and hash."""
    ref = F.concat(F.lit("sigma:"), "rule_id", F.lit(":"), F.substring(F.sha2("document", 256), 1, 12))
    return rules.select(ref.alias("source_ref"), F.concat_ws("\n", F.concat(F.lit("Sigma rule: "), "title", F.lit(" ("), F.coalesce("level", F.lit("unknown")), F.lit(")")), "document").alias("content"))


def yara_project(rules: DataFrame) -> DataFrame:
    """A row per rule of rules (name, raw, meta map, tags), with the columns of a YARA rule; modifiers, imports and the
    condition are read from the rule's text."""
    m = lambda k: F.nullif(F.col("meta")[k], F.lit(""))
    one = lambda k: F.when(m(k).isNotNull(), F.array(m(k))).otherwise(F.array().cast("array<string>"))
    before = F.regexp_extract("raw", r"(?s)^(.*?)\brule\s+\w+", 1)
    condition = F.btrim(F.regexp_extract("raw", r"(?s)condition:(.*)\}", 1), F.lit(" \t\r\n"))
    return rules.select(
        rule_id(F.col("meta")["id"], F.col("raw"), "yara").alias("rule_id"), F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("unknown_rule")).alias("title"), F.lit("yara").alias("source_format"),
        F.sha2("raw", 256).alias("content_sha256"), *[m(k).alias(k) for k in ("description", "author", "date", "modified")], one("report").alias("references"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.lower(m("status")).alias("status"), m("sharing").alias("tlp"), "name", m("id").alias("cccs_id"), m("fingerprint").alias("fingerprint"), m("category").alias("category"), m("technique").alias("technique_tag"),
        m("version").alias("cccs_version"), one("hash").alias("hash_of_sample"), before.rlike(r"\bprivate\b").alias("is_private"), before.rlike(r"\bglobal\b").alias("is_global"), F.nullif(condition, F.lit("")).alias("condition"),
    )


def yara_tag(tag: Column) -> tuple[Column, Column, Column]:
    """(entity type, value, namespace) of a tag; every tag has one."""
    t = F.trim(tag)
    technique, cve = t.rlike(r"(?i)^(?:attack[._])?t\d{4}(?:\.\d{3})?$"), t.rlike(r"(?i)^cve[_-]?\d{4}[_-]\d{4,7}$")
    kind = F.when(technique, "AttackPattern").when(cve, "Vulnerability").otherwise("YaraTag")
    category = F.upper(t).isin(*CATEGORY_TOKENS)
    value = F.when(technique, F.concat(F.lit("T"), F.regexp_extract(t, r"(\d{4}(?:\.\d{3})?)$", 1))).when(cve, F.concat(F.lit("CVE-"), F.replace(F.regexp_extract(t, r"(\d{4}[_-]\d{4,7})$", 1), F.lit("_"), F.lit("-")))).when(category, F.upper(t)).otherwise(t)
    return kind, value, F.when(technique | cve, F.lit(None)).when(category, "category").otherwise("freeform")


def yara_tag_resolve(tags: DataFrame) -> DataFrame:
    kind, value, space = yara_tag(F.col("tag"))
    return tags.select("rule_id", "tag", kind.alias("entity_type"), value.alias("entity_value"), space.alias("namespace"))


def yara_edges(rules: DataFrame) -> DataFrame:
    """(rule_id, rel, to_type, to_value) of rules (rule_id, meta map, tags): one edge per tag, technique id, technique and actor."""
    meta = lambda k: F.col("meta")[k]
    ids = rules.select("rule_id", F.explode(F.split(F.replace(meta("mitre_att"), F.lit(";"), F.lit(",")), ",")).alias("v")).select("rule_id", F.lit("detects").alias("rel"), F.lit("AttackPattern").alias("to_type"), F.upper(F.trim("v")).alias("to_value")).where("to_value <> ''")
    named = rules.where(meta("technique") != "").select("rule_id", F.lit("tagged_with"), F.lit("YaraTag"), meta("technique"))
    actors = rules.where(meta("actor") != "").select("rule_id", F.lit("attributed_to"), F.lit("ThreatActor"), meta("actor"))
    kind, value, _ = yara_tag(F.col("tag"))
    tags = rules.select("rule_id", F.explode("tags").alias("tag")).select("rule_id", F.when(kind == "AttackPattern", "detects").when(kind == "Vulnerability", "references_cve").otherwise("tagged_with"), kind, value)
    return ids.union(named).union(actors).union(tags)


def cccs_validate(rules: DataFrame, tier: str = "warn") -> DataFrame:
    """(rule_id, errors, warnings, accepted) of rules (rule_id, meta map) under "strict", "warn" or "non_cccs"."""
    none = F.array().cast("array<string>")
    if tier == "non_cccs":
        return rules.select("rule_id", none.alias("errors"), none.alias("warnings"), F.lit(True).alias("accepted"))
    value = lambda k: F.col("meta")[k]
    missing = [F.when(F.coalesce(value(k), F.lit("")) == "", F.lit(f"missing required CCCS field: {k}")) for k in REQUIRED_FIELDS]
    wrong = {k: F.when((value(k) != "") & ~value(k).rlike(form), F.lit(f"{k}: wrong form")).when(value(k) == "", F.lit(f"{k}: empty value")) for k, form in FIELD_FORMS.items()}
    hard = F.array_compact(F.array(*missing, *[w for k, w in wrong.items() if k in REQUIRED_FIELDS]))
    soft = F.array_compact(F.array(*[w for k, w in wrong.items() if k not in REQUIRED_FIELDS]))
    if tier == "strict":
        return rules.select("rule_id", hard.alias("errors"), soft.alias("warnings"), (F.size(hard) == 0).alias("accepted"))
    return rules.select("rule_id", none.alias("errors"), F.concat(hard, soft).alias("warnings"), F.lit(True).alias("accepted"))


def cccs_tier_gate(checked: DataFrame, tier: str) -> DataFrame:
    """Adds ``compliance``: "strict" for rows that pass strict checks, "non_cccs" where none were asked for, else "warn".
    Under "strict", rows that aren't accepted go."""
    strict = F.lit(tier == "strict") & F.col("accepted") & (F.size("errors") == 0)
    label = F.lit("non_cccs") if tier == "non_cccs" else F.when(strict, "strict").otherwise("warn")
    rows = checked.withColumn("compliance", label)
    return rows.where("accepted") if tier == "strict" else rows


def rule_explanation_coerce(completions: DataFrame) -> DataFrame:
    """Typed explanations from JSON answers: defaults for missing parts, confidence within 0 and 1."""
    get = lambda k: F.get_json_object("json", f"$.{k}")
    number = F.expr("try_cast(get_json_object(json, '$.confidence') AS DOUBLE)")
    return completions.select("rule_id", F.coalesce(F.nullif(get("summary"), F.lit("")), F.lit("explanation unavailable: missing summary")).alias("summary"), F.coalesce(get("mechanism"), F.lit("")).alias("mechanism"), F.coalesce(F.from_json(get("related_techniques"), "array<string>"), F.array().cast("array<string>")).alias("related_techniques"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0)))).alias("confidence"))


def rule_prompt_prepare(rules: DataFrame, limit: int = 8192) -> DataFrame:
    """(rule_id, body): the body cut at ``limit`` characters, its delimiters escaped."""
    return rules.select("rule_id", F.replace(F.substring("document", 1, limit), F.lit("</rule>"), F.lit("<\\/rule>")).alias("body"))
