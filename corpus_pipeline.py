"""Documents to training sequences: five of the text operators, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwork.llm import langid, mixing, packing, simhash, substrings
from tillwork.llm.common import stash, table
from tillwork.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language with any confidence, go."""
    return langid.in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return simhash.one_of_each(docs, size=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document holds are cut out of the text."""
    return substrings.drop_repeats(docs, window=13)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not, once or twice."""
    return mixing.repeat(docs, share=1.5, cap=2, weights=(5, 2, 1))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, limit=4096)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
    ("source_mix", source_mix), ("packed_sequences", packed_sequences),
]
ORACLE_SQL = None  # SQL cannot express language models, fingerprints or packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read back before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
