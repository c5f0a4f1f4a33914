"""The data side of answering: sources, context, parsing of answers and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def synthesis_sources(entity_hits: DataFrame, recalled: DataFrame, notes: DataFrame, tiers: tuple[str, ...] = ("A", "B"), k: int = 10) -> DataFrame:
    """(query_id, rank, note_id): entity hits first, then recalled notes, of the given tiers, the first k."""
    both = entity_hits.select("query_id", "note_id", F.lit(0).alias("src"), "rank").union(recalled.select("query_id", "note_id", F.lit(1), "rank"))
    best = both.groupBy("query_id", "note_id").agg(F.min(F.struct("src", "rank")).alias("o"))
    kept = best.join(notes.where(F.col("tier").isin(*tiers)).select("note_id"), "note_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("o", "note_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "note_id")


def synthesis_context(sources: DataFrame, notes: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, context, tokens): up to ``most`` notes, 500 characters each; tokens are characters by four."""
    rows = sources.where(F.col("rank") <= most).join(notes.select("note_id", "tier", "content_raw"), "note_id")
    part = F.concat(F.lit("--- NOTE: "), "note_id", F.lit(" (Tier "), "tier", F.lit(") ---\n"), F.substring("content_raw", 1, 500))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n")
    return rows.groupBy("query_id").agg(text.alias("context")).withColumn("tokens", F.floor(F.length("context") / 4))


def extract_json(raw: Column, expect: str = "object") -> Column:
    """The JSON object or array inside an answer, code fences and prose around it dropped; null where there is none."""
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n?(.*?)```", 1), F.lit(""))
    found = F.regexp_extract(F.coalesce(fenced, raw), r"(?s)\{.*\}" if expect == "object" else r"(?s)\[.*\]", 0)
    return F.when((found != "") & F.get_json_object(found, "$").isNotNull(), found)


def synthesis_result(answers: DataFrame, sources: DataFrame, notes: DataFrame) -> DataFrame:
    """(query_id, answer, confidence, n_sources): the model's answer, or a typed fallback where it can't be read."""
    j = extract_json(F.col("raw"))
    said, sure = F.get_json_object(j, "$.answer"), F.get_json_object(j, "$.confidence").cast("double")
    counts = sources.where("rank <= 10").join(notes.select("note_id"), "note_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    out = answers.select("query_id", "text", said.alias("said"), sure.alias("sure")).join(counts, "query_id", "left")
    return out.select("query_id", F.coalesce("said", F.concat(F.lit("No specific answer found for: "), F.substring("text", 1, 50), F.lit("..."))).alias("answer"), F.when(F.col("said").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.coalesce("sure", F.lit(0.0)))).alias("confidence"), F.coalesce("n", F.lit(0)).cast("long").alias("n_sources"))


def validate_synthesis(results: DataFrame, least: float = 0.3, most: int = 20) -> DataFrame:
    """(query_id, errors, valid): confidence and number of sources within limits."""
    errors = F.array_compact(F.array(F.when(F.col("confidence") < least, "confidence below threshold"), F.when(F.col("n_sources") < 1, "sources count below minimum"), F.when(F.col("n_sources") > most, "sources count exceeds maximum")))
    return results.select("query_id", F.array_join(errors, "; ").alias("errors"), (F.size(errors) == 0).alias("valid"))


def quality_score(results: DataFrame) -> DataFrame:
    """(query_id, score, quality): 0.4 confidence by 0.7, 0.3 sources by five, 0.3 for an answer."""
    score = 0.4 * F.least(F.lit(1.0), F.col("confidence") / 0.7) + 0.3 * F.least(F.lit(1.0), F.col("n_sources") / 5) + 0.3 * F.col("answer").isNotNull().cast("double")
    return results.select("query_id", F.round(score, 3).alias("score"), F.when(score >= 0.8, "EXCELLENT").when(score >= 0.5, "GOOD").otherwise("NEEDS_WORK").alias("quality"))
