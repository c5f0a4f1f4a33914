"""Scoring answers and retrieval, sampling questions and generating workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut

_PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def words(text: Column) -> Column:
    """Words of lower-cased text, by white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def keyword_judge(predicted: Column, gold: Column) -> Column:
    """1 if the answer holds the gold text or 70 % of its distinct words, 0.5 from 30 %, else 0."""
    want = F.array_distinct(words(gold))
    ratio = F.size(F.array_intersect(want, words(predicted))) / F.size(want)
    return F.when(F.lower(predicted).contains(F.lower(gold)), 1.0).when(F.size(want) == 0, 0.0).when(ratio >= 0.7, 1.0).when(ratio >= 0.3, 0.5).otherwise(0.0)


def normalize_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and English articles, single blanks."""
    plain = F.regexp_replace(F.lower(text), _PUNCTUATION, "")
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the")), " ")


def token_f1(pairs: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """(key, precision, recall, f1) of the multisets of normalised words."""
    count = lambda c, n: pairs.select(key, F.explode(F.split(normalize_answer(F.col(c)), " ")).alias("w")).where("w <> ''").groupBy(key, "w").agg(F.count("*").alias(n))
    both = count(predicted, "p").join(count(gold, "g"), [key, "w"], "full")
    sums = both.groupBy(key).agg(F.sum(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), F.least("p", "g")).otherwise(0)).alias("same"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    out = pairs.select(key).join(sums, key, "left")
    some = F.coalesce(F.col("same"), F.lit(0)) > 0
    p, r = F.col("same") / F.col("np"), F.col("same") / F.col("ng")
    return out.select(key, F.round(F.when(some, p).otherwise(0.0), 6).alias("precision"), F.round(F.when(some, r).otherwise(0.0), 6).alias("recall"), F.round(F.when(some, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def exact_match(predicted: Column, gold: Column) -> Column:
    return (normalize_answer(predicted) == normalize_answer(gold)).cast("double")


def substring_match(predicted: Column, gold: Column) -> Column:
    return normalize_answer(predicted).contains(normalize_answer(gold)).cast("double")


def best_of_gold(scores: DataFrame, key: str) -> DataFrame:
    """(key, gold_id, f1): each question's gold answer with the best F1, the first of equals."""
    best = scores.groupBy(key).agg(F.min(F.struct((-F.col("f1")).alias("n"), "gold_id")).alias("b"))
    return best.select(key, F.col("b.gold_id").alias("gold_id"), (-F.col("b.n")).alias("f1"))


def set_prf(predicted: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, precision, recall, f1) of sets of values, whatever their case."""
    p = predicted.select(key, F.lower("value").alias("v")).distinct().withColumn("p", F.lit(1))
    e = expected.select(key, F.lower("value").alias("v")).distinct().withColumn("e", F.lit(1))
    sums = p.join(e, [key, "v"], "full").groupBy(key).agg(F.sum(F.coalesce("p", F.lit(0)) * F.coalesce("e", F.lit(0))).alias("tp"), F.count("p").alias("np"), F.count("e").alias("ne"))
    pr, re = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0), F.when(F.col("ne") > 0, F.col("tp") / F.col("ne")).otherwise(0.0)
    return sums.select(key, F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0), 6).alias("f1"))


def attribution_score(predicted: Column, gold: Column) -> Column:
    """1 if one text holds the other, 0.5 if the answer has half of the gold words, else 0."""
    p, g = F.lower(F.trim(predicted)), F.lower(F.trim(gold))
    share = F.size(F.array_intersect(F.array_distinct(words(g)), words(p))) / F.size(F.array_distinct(words(g)))
    return F.when((g != "") & (p != "") & (p.contains(g) | g.contains(p)), 1.0).when((g != "") & (share >= 0.5), 0.5).otherwise(0.0)


def set_recall_in_text(expected: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, found, wanted, recall): expected values that the key's text contains."""
    rows = expected.select(key, F.lower("value").alias("v")).distinct().join(texts.select(key, F.lower("text").alias("t")), key)
    return rows.groupBy(key).agg(F.count(F.when(F.col("t").contains(F.col("v")), 1)).alias("found"), F.count("*").alias("wanted")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))


def context_precision(retrieved: DataFrame, golds: DataFrame, key: str) -> DataFrame:
    """(key, precision): share of a question's retrieved texts that contain any gold word."""
    rows = retrieved.select(key, F.lower("text").alias("t")).join(golds.select(key, F.array_distinct(words(F.col("gold"))).alias("g")), key)
    return rows.groupBy(key).agg(F.round(F.avg(F.when(F.exists("g", lambda w: F.col("t").contains(w)), 1.0).otherwise(0.0)), 6).alias("precision"))


def keyword_presence(gold: Column, context: Column) -> Column:
    """Share of distinct gold words found in the context."""
    want = F.array_distinct(words(gold))
    return F.when(F.size(want) == 0, 0.0).otherwise(F.size(F.filter(want, lambda w: F.lower(context).contains(w))) / F.size(want))


def negative_score(questions: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """(key, score): 1 for questions without a hit."""
    n = hits.groupBy(key).agg(F.count("*").alias("n"))
    return questions.select(key).join(n, key, "left").select(key, F.when(F.col("n") > 0, 0.0).otherwise(1.0).alias("score"))


def evolve_score(status: Column, expected: Column, acceptable: Column) -> Column:
    """1 for the expected status, 0.5 for an acceptable one; "created" counts as "added"."""
    low = F.coalesce(F.lower(F.trim(status)), F.lit("unknown"))
    plain = F.when(low == "created", "added").otherwise(low)
    return F.when(plain == expected, 1.0).when(F.array_contains(acceptable, plain), 0.5).otherwise(0.0)


def accuracy_by_category(scores: DataFrame) -> DataFrame:
    """Share of full scores, mean score and number per category, and over all (null category), by rollup."""
    return scores.rollup("category").agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("score") == 1).cast("double")), 6).alias("exact_percent"), F.round(F.avg("score"), 6).alias("mean_score"))


def qa_sample_per_category(rows: DataFrame, category: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(category).orderBy(order)
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")


def span_entities(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, label, value): the parts of a text that spans (label, start, end) mark."""
    return spans.join(texts, key).select(key, "label", F.expr("substring(text, start + 1, end - start)").alias("value"))


def generate_qa(index: DataFrame, least: int = 2) -> DataFrame:
    """(kind, question, answer, n): count questions for entities, co-occurrence questions for actors and tools, negatives.

    One pass over the index counts entities and pairs, and what follows works on the counts.
    """
    named = index.where("note_id IS NOT NULL").groupBy("note_id").agg(F.collect_set(F.struct("entity_type", "entity_value")).alias("all")).select("all", F.explode("all").alias("e"))
    tools = F.when(F.col("e.entity_type") == "intrusion_set", F.filter("all", lambda x: x["entity_type"] == "tool")["entity_value"])
    rows = named.select("e.*", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(tools, F.array().cast("array<string>")))).alias("tool"))
    tally = cut(rows.groupBy("entity_type", "entity_value", "tool").agg(F.count("*").alias("n")))  # entities, and actors with a tool
    counts = tally.where(F.col("tool").isNull() & (F.col("n") >= least))
    counted = counts.select(F.lit("count").alias("kind"), F.concat(F.lit("How many notes mention "), "entity_value", F.lit("?")).alias("question"), F.col("n").cast("string").alias("answer"), "n")
    met = tally.where("tool IS NOT NULL").select(F.col("entity_value").alias("actor"), "tool", "n")
    both = met.where(F.col("n") >= least)
    used = both.select(F.lit("uses").alias("kind"), F.concat(F.lit("Does "), "actor", F.lit(" use "), "tool", F.lit("?")).alias("question"), F.lit("yes").alias("answer"), "n")
    tools = tally.where("entity_type = 'tool' AND tool IS NULL").select(F.col("entity_value").alias("tool"))
    pairs = both.select("actor").distinct().join(tools.withColumn("one", F.lit(1)), F.lit(True)).select("actor", "tool")
    never = pairs.join(met, ["actor", "tool"], "left_anti")
    none = never.select(F.lit("negative").alias("kind"), F.concat(F.lit("Does "), "actor", F.lit(" use "), "tool", F.lit("?")).alias("question"), F.lit("no").alias("answer"), F.lit(0).cast("long").alias("n"))
    return counted.union(used).union(none)


# fixed values: vocabulary of generated notes
ACTORS = ("APT28", "APT29", "Lazarus", "Sandworm", "FIN7", "UNC2452", "TA505")
TOOLS = ("Cobalt Strike", "Mimikatz", "Metasploit", "BloodHound", "Empire")
SECTORS = ("energy", "finance", "government", "healthcare", "telecom")


def generate_corpus(rows: DataFrame, key: str) -> DataFrame:
    """(key, content_raw): one synthetic note per row, chosen by hashes of its key."""
    pick = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    actor, tool, sector = pick(ACTORS, 1), pick(TOOLS, 2), pick(SECTORS, 3)
    cve = F.format_string("CVE-2024-%04d", F.pmod(F.xxhash64(F.col(key), F.lit(4)), F.lit(500)))
    forms = (F.concat(actor, F.lit(" used "), tool, F.lit(" against the "), sector, F.lit(" sector.")), F.concat(actor, F.lit(" exploited "), cve, F.lit(".")), F.concat(tool, F.lit(" was seen with "), cve, F.lit(" in "), sector, F.lit(".")))
    form = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(3))
    return rows.select(key, F.when(form == 0, forms[0]).when(form == 1, forms[1]).otherwise(forms[2]).alias("content_raw"))
