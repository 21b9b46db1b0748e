"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import (
    alignment, conversations, disclosure, langid, linequality, mixing, multiindex, oracles, ordinal, packing, simhash, substrings, tokens, toxicity,
)
from tillwork.llm.common import columns, table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substrings.parse(table(spark, sf_dir, "documents"), window=13)
    return parsed.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), buckets=5, held_out=0)


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 poor, 1 good but toxic, 2 good; kept where a good grade is likelier than not."""
    labels = columns(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")
    ratings = labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))
    return ordinal.grade(table(spark, sf_dir, "documents"), ratings, grades=3, wanted=1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), buckets=4, held_out=2)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, limit=4096)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, cap=2, weights=(5, 2, 1))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, max_bits=4, seed=42)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linequality.judge(table(spark, sf_dir, "documents"), least=5)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(whole), every=columns(whole, "conv_id"))


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find(table(spark, sf_dir, "documents"), support=2)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_toxicity, op3_inverted_multi_index, op4_quality_classifier, op5_language_id,
        op6_best_fit_packing, op7_source_mixing, op8_simhash_near_dedup, op9_token_counts, op10_line_quality,
        op11_tokenizer_alignment, op12_conversation_repair, op13_disclosure)}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op10_line_quality": oracles.LINE_QUALITY,
    "op13_disclosure": oracles.DISCLOSURE,
}
