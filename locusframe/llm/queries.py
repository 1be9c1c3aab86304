"""The registered queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, hard_negatives, line_dedup, mixing, ngram_join, packing, quality, quality_rules, sharding, token_counts, toxicity, warc
from .oracles import ORACLE_SQL
from .runtime import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Weights over training time of the sources in turn: 5, 2 and 1 on the whole, from broad to special.
CURRICULUM = [[(0, 7.5), (1, 2.5)], [(0, 2), (1, 2)], [(0, 0.25), (0.5, 0.75), (1, 2.25)]]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of low quality and toxicity for every document, and the verdict.

    Fitted without the labels of held-out documents (see quality.held_out), so that the
    verdicts on these tell how good it is. The table of labels has these two categories.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marked = labels.where(~quality.held_out()).select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train(docs, marked, ["low_quality", "toxic"])
    scored = toxicity.probabilities(docs, chain)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "p_low_quality", "p_toxic", (F.col("p_toxic") >= chain.cutoffs[1]).cast("int").alias("toxic"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, with its similarity and place."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 0.8)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), 0.8)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document after the loss of lines found in 10 documents or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, min_docs=10)
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = quality_rules.assess(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in names], "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies, with a checksum of its ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, 1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold when they are read back."""
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, near equal in bytes."""
    shards = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in the order of its first training position."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.curriculum(docs, mixing.cycled_schedules(docs, CURRICULUM), share=1.5, cap=2.0)
    first = mixed.withColumn("position", F.get("copies", F.lit(0))["position"])
    return first.orderBy(F.col("position").asc_nulls_last(), "place").select("doc_id", "size", "source_size", "target", "taken", "position")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten negatives in the window of each of five positives of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, contained=100, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All opN_ queries by name."""
    return {f.__name__: f for f in (op1_toxicity, op2_quality, op3_decontaminate, op4_ngram_join, op5_line_dedup, op6_quality_rules, op7_token_counts, op8_packing, op9_warc, op10_sharding, op11_mixing, op12_hard_negatives, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return dict(ORACLE_SQL)
