"""The corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup (of
passages by words, then of strings by bytes), mixing to target weights, packing.
Each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import jaccard_join, language_id, mixing, packing, suffix_dedup
from stowage.llm.common import documents, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language_id.accept(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, 0.8 and more."""
    return jaccard_join.keep_one(docs, n=5, num=4, den=5)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text loses passages of over 50 words that start elsewhere too; most of them
    are shorter than 400 bytes."""
    return documents(suffix_dedup.remove_passages(docs))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text loses what 400-byte strings that start elsewhere too cover."""
    return documents(suffix_dedup.dedup(docs, length=400, with_text=True))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed into sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("jaccard_join", join_near_copies), ("passage_dedup", remove_passages), ("suffix_dedup", remove_repeats), ("mixing", mix_sources), ("packing", pack)]

#: SQL has no suffix arrays, trained models or tokenizers; tests/llm compares
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the pieces of the last one.

    Null and empty texts and texts without letters go with the first stage, so
    later ones only meet them where a removal leaves nothing: such a document
    stays, as one token. Rows that repeat an id are documents of their own; null
    ids, languages and sources are kept; very long texts are read whole; extra
    columns are dropped at the start; an empty table gives an empty result.
    """
    docs = documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
