"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldglass.llm import bpe, decontaminate, near_dup, pii, quality_rules
from fieldglass.llm.common import landed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut failing lines; documents that fail the rules go."""
    return quality_rules.clean_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, similarity 0.8 or more)."""
    return near_dup.clean_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a test item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data."""
    return pii.clean_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality_rules", quality), ("near_dedup", dedup), ("decontaminate", decontaminated), ("pii", private),
    ("bpe", tokens),
]
#: SQL can't express the learned contexts and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
