"""One registered query per operator, over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.llm import (
    boosting,
    common,
    decontaminate,
    exact_dedup,
    language_id,
    language_model,
    lexical_search,
    merkle,
    near_dedup,
    packing,
    pii,
    quality_rules,
    token_count,
    training_order,
)
from vitalgrid.llm.oracles import ORACLES  # noqa: F401


def op1_recurrent_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned outside the held-out fold."""
    return language_model.model_scores(common.table(spark, sf_dir, "documents"))


def op2_resynchronised_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_count.counts(common.table(spark, sf_dir, "documents"))


def op3_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the shards of all documents; slot, place and checksum of every sequence."""
    return training_order.shard_table(spark, f"{sf_dir}/documents.parquet")[0]


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    return boosting.scored(docs, boosting.train(docs, common.table(spark, sf_dir, "labels")))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    return pii.report(common.table(spark, sf_dir, "documents"))


def op6_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits and verdict of every document."""
    return decontaminate.report(
        common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    )


def op7_recurrent_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = common.table(spark, sf_dir, "documents")
    return language_id.predicted(docs, language_id.train(docs))


def op8_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return packing.packed(packing.pieces(common.table(spark, sf_dir, "documents")))


def op9_kneser_ney_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted figures and verdict of every document."""
    return quality_rules.judged(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity"
    )


def op10_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and verdict of every document."""
    return near_dedup.near_groups(common.table(spark, sf_dir, "documents"))


def op11_quotient_filter_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts and verdict of every document."""
    return exact_dedup.exact_groups(common.table(spark, sf_dir, "documents"))


def op12_presence_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_lag_lead_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its tampered form is found out."""
    return merkle.manifest(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_recurrent_lm_scoring": op1_recurrent_lm_scoring,
    "op2_resynchronised_token_counts": op2_resynchronised_token_counts,
    "op3_feistel_training_order": op3_feistel_training_order,
    "op4_boosted_quality": op4_boosted_quality,
    "op5_contextual_pii": op5_contextual_pii,
    "op6_ngram_decontamination": op6_ngram_decontamination,
    "op7_recurrent_language_id": op7_recurrent_language_id,
    "op8_grouping_genetic_packing": op8_grouping_genetic_packing,
    "op9_kneser_ney_quality_rules": op9_kneser_ney_quality_rules,
    "op10_superminhash_near_dedup": op10_superminhash_near_dedup,
    "op11_quotient_filter_exact_dedup": op11_quotient_filter_exact_dedup,
    "op12_presence_mask_search": op12_presence_mask_search,
    "op13_lag_lead_merkle_manifest": op13_lag_lead_merkle_manifest,
}
