"""Building notes and their life cycle: context, keywords, ids, persistence, expiry, chunks, de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import KEYWORD_STOPWORDS, TTL_DAYS


def context_sentence(text: Column) -> Column:
    """Text before the first full stop, trimmed; over 150 characters, cut and marked."""
    first = F.trim(F.split_part(text, F.lit("."), F.lit(1)))
    return F.when(F.length(first) > 150, F.concat(F.substring(first, 1, 150), F.lit("..."))).otherwise(first)


def keyword_counts(notes: DataFrame, key: str = "note_id", text: str = "content_raw") -> DataFrame:
    """(key, keyword, n, first): words of four or more Latin letters without stop words, and where they first occur."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    found = notes.select(key, F.posexplode(words).alias("at", "keyword")).where(F.col("keyword").rlike("^[a-z]{4,}$") & ~F.col("keyword").isin(*KEYWORD_STOPWORDS))
    return found.groupBy(key, "keyword").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def keywords_topk(notes: DataFrame, k: int = 10, key: str = "note_id", text: str = "content_raw") -> DataFrame:
    """(key, rank, keyword): the k most common keywords, ties by first appearance."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return keyword_counts(notes, key, text).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "keyword", "n")


def keyword_array(text: Column, k: int = 7) -> Column:
    """The k most common keywords of ``text`` as one expression, ties by first appearance."""
    whole = r"(?<![\p{L}\p{N}_])[a-z]{4,}+(?![\p{L}\p{N}_])"
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(whole), F.lit(0)), lambda w: ~w.isin(*KEYWORD_STOPWORDS))

    def ranked(words: Column) -> Column:
        counts = F.transform(F.array_distinct(words), lambda w: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), F.array_position(words, w).alias("at"), w.alias("w")))
        return F.transform(F.slice(F.array_sort(counts), 1, k), lambda x: x["w"])

    return F.get(F.transform(F.array(words), ranked), F.lit(0))  # words are looked for once, not for each of them


def input_hash(raw: Column, context: Column, keywords: Column, tags: Column) -> Column:
    """First 16 hex digits of the SHA-256 of content, context, keywords and tags."""
    return F.substring(F.sha2(F.concat(raw, context, F.array_join(keywords, ""), F.array_join(tags, "")), 256), 1, 16)


def note_id(raw: Column, source_ref: Column) -> Column:
    """An id that depends on content and source only, so that a replay gives the same one."""
    return F.concat(F.lit("note_"), F.substring(F.sha2(F.concat_ws("\x1f", source_ref, raw), 256), 1, 16))


def construct_notes(notes: DataFrame, embed: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """Adds context, seven keywords, tags, tier A and the input hash to raw notes (content_raw, domain).

    With ``embed`` (rows, key, text) -> (key, vector), such as ``retrieve.embed_batch``, each note (note_id) gets the
    ``vector`` of its text.
    """
    tags = F.slice(F.array("domain"), 1, 5)
    built = notes.withColumns({"context": context_sentence(F.col("content_raw")), "keywords": keyword_array(F.col("content_raw"), 7), "tags": tags, "tier": F.lit("A")})
    built = built.withColumn("input_hash", input_hash(F.col("content_raw"), F.col("context"), F.col("keywords"), F.col("tags")))
    return built if embed is None else built.join(embed(notes.select("note_id", "content_raw"), "note_id", "content_raw"), "note_id", "left")


def governance_validate(notes: DataFrame, limit: int = 50_000) -> DataFrame:
    """Adds ``violation``: missing content, content over ``limit`` characters, or null."""
    return notes.withColumn("violation", F.when(F.col("content_raw").isNull(), "GOV-011").when(F.length("content_raw") > limit, "LIMIT"))


def infer_persistence(source_type: Column, domain: Column) -> Column:
    return (
        F.when(source_type.isin("ingestion", "report") & (domain == "cti"), "knowledge").when(source_type == "synthesis", "wisdom")
        .when((source_type == "task_output") & (domain != "cti"), "intelligence").otherwise("memory")
    )


def expire_filter(notes: DataFrame, as_of: str, updated: str = "created_at") -> DataFrame:
    """Notes that have not outlived their class's days at ``as_of``; unlisted classes never expire.

    Days count from the latest of ``updated``, or ``ttl_anchor`` in its place, and ``updated_at``, as far as ``notes`` have
    these columns: an access starts them anew.
    """
    anchor = F.coalesce("ttl_anchor", updated) if "ttl_anchor" in notes.columns else F.col(updated)
    anchor = F.when(anchor.isNotNull(), F.greatest(anchor, "updated_at")) if "updated_at" in notes.columns else anchor
    ttl = F.create_map(*[x for k, d in TTL_DAYS for x in (F.lit(k), F.lit(d))])
    age = F.datediff(F.lit(as_of).cast("timestamp"), anchor)
    return notes.where(F.coalesce(age <= ttl[F.col("persistence")], F.lit(True)))


def review_flag(confidence: Column, evolution_count: Column) -> Column:
    return (confidence < 0.5) | (evolution_count > 5)


def track_access(notes: DataFrame, hits: DataFrame) -> DataFrame:
    """(note_id, access_count, last_accessed) from ``hits`` (note_id, ts)."""
    counts = hits.groupBy("note_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_accessed"))
    return notes.select("note_id").join(counts, "note_id", "left").select("note_id", F.coalesce("n", F.lit(0)).cast("long").alias("access_count"), "last_accessed")


def bump_evolution(notes: DataFrame) -> DataFrame:
    """One more evolution, confidence at most 0.95."""
    return notes.withColumns({"evolution_count": F.col("evolution_count") + 1, "confidence": F.least("confidence", F.lit(0.95))})


def valid_embedding(vector: Column, dim: int) -> Column:
    """Right length, some non-zero component, variance of at least 0.001."""
    d = F.transform(vector, lambda x: x.cast("double"))
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.lit(float(dim))
    var = F.aggregate(d, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.lit(float(dim))
    return F.coalesce((F.size(vector) == dim) & F.exists(d, lambda x: x != 0) & (var >= 0.001), F.lit(False))


def dedupe_content(new: DataFrame, stored: DataFrame | None = None, text: str = "content_raw", order: str = "note_id") -> DataFrame:
    """The first of ``new`` (by ``order``) for each content hash that ``stored`` (content_hash) does not hold."""
    hashed = new.withColumn("content_hash", F.substring(F.sha2(F.col(text), 256), 1, 32))
    if stored is not None:
        hashed = hashed.join(stored.select("content_hash"), "content_hash", "left_anti")
    first = hashed.groupBy("content_hash").agg(F.min(order).alias(order))
    return hashed.join(first, ["content_hash", order], "left_semi")


def dedupe_source_ref(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``new`` whose source_ref is not among ``stored``."""
    return new.join(stored.select("source_ref").distinct(), "source_ref", "left_anti").select(*new.columns)


def chunk_report(notes: DataFrame, size: int = 3000, text: str = "content_raw", ref: str = "source_ref") -> DataFrame:
    """(ref, chunk_ref, chunk): texts over ``size`` cut at sentence ends and packed greedily; others whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(". "), s))
        full = (F.length(joined) > size) & (acc["cur"] != "")
        return F.struct(F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(joined).alias("cur"))

    folded = F.aggregate(F.split(F.col(text), r"\. "), start, step, lambda a: F.array_append(a["done"], a["cur"]))
    chunks = F.when(F.length(text) > size, folded).otherwise(F.array(F.col(text)))
    return notes.select(ref, F.posexplode(chunks).alias("i", "chunk")).select(ref, F.concat(F.col(ref).cast("string"), F.lit(":chunk:"), F.col("i").cast("string")).alias("chunk_ref"), "chunk")


def chunk_sentences(notes: DataFrame, key: str, text: str, size: int = 2048, overlap: int = 0, least: int = 20) -> DataFrame:
    """(key, i, chunk): sentences packed greedily to ``size`` characters, each chunk after the first carrying the last
    ``overlap`` characters of the one before; chunks of at most ``least`` characters are dropped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        full = (F.length(joined) > size) & (acc["cur"] != "")
        carry = F.concat(F.right(acc["cur"], F.lit(overlap)), F.lit(" "), s) if overlap else s
        return F.struct(F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"), F.when(full, carry).otherwise(joined).alias("cur"))

    chunks = F.aggregate(F.split(F.col(text), r"(?<=[.!?])\s+"), start, step, lambda a: F.filter(F.array_append(a["done"], a["cur"]), lambda c: F.length(c) > least))
    return notes.select(key, F.posexplode(chunks).alias("i", "chunk"))


def session_notes(turns: DataFrame, limit: int = 4000) -> DataFrame:
    """(conv_id, content): one note per conversation, its turns in order, cut at ``limit`` characters.

    If ``turns`` have a ``date``, the first one of a conversation stands in the head, in brackets.
    """
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    head = F.col("conv_id").cast("string")
    if "date" in turns.columns:
        day = F.min_by(F.col("date").cast("string"), "turn")
        head = F.concat(head, F.coalesce(F.concat(F.lit(" ("), day, F.lit(")")), F.lit("")))
    return turns.groupBy("conv_id").agg(F.substring(F.concat(F.lit("Conversation session "), head, F.lit(":\n"), body), 1, limit).alias("content"))


def recent_notes(notes: DataFrame, limit: int = 10) -> DataFrame:
    return notes.orderBy(F.desc("created_at"), "note_id").limit(limit)


# fixed values: kinds of personal data and their patterns, scores and whether they are indicators
PII = (
    ("EMAIL_ADDRESS", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 1.0, False),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.95, True),
    ("PHONE_NUMBER", r"\+?\d{0,2} ?\(\d{3}\) ?\d{3}-\d{4}", 0.75, False),
    ("DOMAIN_NAME", r"\b(?:[a-z0-9-]+\.)+(?:com|net|org)\b", 0.5, True),
)


_SPANS = "array<struct<len:int,score:double,start:int,end:int,kind:string,value:string>>"


def _spans_of(text: Column, kind: str, pattern: str, score: float) -> Column:
    """Spans of one kind; each match begins where the text between it and the one before ends."""

    def place(acc: Column, x: Column) -> Column:
        v, start = x["match"], acc["at"] + F.length(x["before"])
        span = F.struct(F.length(v).alias("len"), F.lit(score).alias("score"), start.alias("start"), (start + F.length(v)).alias("end"), F.lit(kind).alias("kind"), v.alias("value"))
        return F.struct(F.when(v.isNull(), acc["at"]).otherwise(start + F.length(v)).alias("at"), F.when(v.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    seed = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern), lambda m, b: F.struct(m.alias("match"), b.alias("before")))
    return F.aggregate(found, seed, place, lambda a: a["out"])


def pii_detect(notes: DataFrame, key: str, text: str, exempt_indicators: bool = True) -> DataFrame:
    """(key, entity_type, start, end, match): typed spans, overlaps resolved by length, then score, in order of start."""
    none = F.array().cast(_SPANS)
    spans = F.concat(none, *[_spans_of(F.col(text), *spec[:3]) for spec in PII if not (spec[3] and exempt_indicators)])
    longest = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["len"].alias("len"), s["score"].alias("score"), (-s["start"]).alias("neg"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    kept = F.aggregate(longest, empty, lambda acc, d: F.when(F.exists(acc, lambda s: (d["start"] < s["end"]) & (d["end"] > s["start"])), acc).otherwise(F.array_append(acc, F.struct(d["start"].alias("start"), d["end"].alias("end"), d["kind"].alias("kind"), d["value"].alias("value")))))
    return notes.select(key, F.explode(F.array_sort(kept)).alias("s")).select(key, F.col("s.kind").alias("entity_type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("match"))


def pii_apply(notes: DataFrame, key: str, text: str, action: str = "redact", placeholder: str = "[REDACTED]") -> DataFrame:
    """(key, content): personal data redacted, rows with any blocked, or passed through by ``action``."""
    pattern = "|".join(p for _, p, _, indicator in PII if not indicator)
    if action == "redact":
        return notes.select(key, F.regexp_replace(F.col(text), pattern, placeholder).alias("content"))
    rows = notes.where(~F.col(text).rlike(pattern)) if action == "block" else notes
    return rows.select(key, F.col(text).alias("content"))
