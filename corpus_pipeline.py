"""A corpus pipeline of the operators in locusframe.llm: each stage is written and read again.

Stages take any columns besides doc_id, text, lang, source and n_chars along. Null texts count
as empty, so the quality rules reject them; rows without a doc_id are never duplicates of others
and never go for a benchmark item; repeated rows are one document from the n-gram join on. An
empty table passes through, and packs to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from locusframe.llm.queries import BYTE_BPE
from locusframe.llm.runtime import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those without a text or ten words among them."""
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; n_chars is counted anew (null for a null text)."""
    kept = line_dedup.dedup_lines(docs, min_docs=10)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least doc_id; all without one stay."""
    return ngram_join.keep_one(docs, 0.8).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id; those without a doc_id stay."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), 0.8).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids; a null text is one end-of-document id."""
    return packing.pack(docs, BYTE_BPE, 1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: SQL can't express the n-gram join, decontamination and packing; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
