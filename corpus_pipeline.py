"""A corpus pipeline: toxicity, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The first three return the columns
of ``docs``; the last returns the pieces of packed sequences. A document is named by its doc_id: rows that share an id stay
or go together, and rows without an id, which no class can name, stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from notelattice.llm.ngram_join import jaccard_classes
from notelattice.llm.packing import pack
from notelattice.llm.quality import kept_rows
from notelattice.llm.queries import tokenizer_path
from notelattice.llm.scratch import materialize
from notelattice.llm.toxicity import clean_rows, fit


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Fewer rows in a batch for Python workers, as the stages share one application; the setting is put back at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the cutoff."""
    with small_batches(spark):
        return materialize(clean_rows(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))), "clean")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's references."""
    with small_batches(spark):
        return materialize(kept_rows(docs), "kept")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8 or more)."""
    with small_batches(spark):
        gone = materialize(jaccard_classes(docs, n=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of sequences of 4096 tokens, neighbours on a space-filling curve together."""
    with small_batches(spark):
        return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096, keep=False)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("ngram_jaccard_join", ngram_jaccard_join), ("packing", packing)]

#: Trained weights, divergences and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
