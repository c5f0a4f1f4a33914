"""Queries over the whole given tables, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encoded_digests
from .chat import formatted_digests
from .lexical import lexical_search
from .ngram_join import jaccard_classes
from .packing import pack
from .quality import quality_rules
from .repeats import removal_digests
from .scratch import scratch_path
from .sharding import sharded_digests
from .spelling import spelling_variants
from .token_files import token_file_round_trip
from .toxicity import toxicity
from .vectors import near_duplicate_vectors
from .warc import page_records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_records(_table(spark, sf_dir, "pages"), scratch_path(spark, "warc"), min_bytes=0)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("CAST(-7 AS BIGINT) AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return formatted_digests(rows.union(extra))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_digests(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(_table(spark, sf_dir, "documents"), window=20)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_warc, op2_ngram_jaccard_join, op3_toxicity, op4_bpe, op5_chat_formatting, op6_packing, op7_quality_rules, op8_sharding, op9_token_files, op10_embedding_near_dedup,
        op11_ranked_lexical_search, op12_substring_dedup, op13_spelling_variants,
    )
    return {f.__name__: f for f in every}


#: Terms of a lower-cased text, for op11.
_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
     sizes AS (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
     whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
     item_terms AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) t GROUP BY ALL),
     posts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) t WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
     weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posts, whole GROUP BY term, big_n),
     scores AS (
       SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
       FROM item_terms JOIN posts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0) t WHERE place <= 10
"""

REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     win AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS content FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d) t),
     found AS (SELECT doc_id, s, first_value(doc_id) OVER w AS d0, first_value(s) OVER w AS s0 FROM win WINDOW w AS (PARTITION BY content ORDER BY doc_id, s)),
     gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS place FROM found WHERE doc_id <> d0 OR s <> s0),
     words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM d),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS body, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_sharding": "SELECT doc_id, lang, source, octet_length(encode(text)) AS text_bytes, sha256(text) AS text_sha256 FROM documents",
        "op11_ranked_lexical_search": SEARCH_SQL,
        "op12_substring_dedup": REPEATS_SQL,
    }
