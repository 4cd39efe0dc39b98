"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard_join, language_id, licences, lm_scoring, mixing, neighbours, packing, quality, sql, suffix_dedup
from .common import read_documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(read_documents(spark, sf_dir), length=400, with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "longest_repeat")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_documents(spark, sf_dir), n=3, num=9, den=10)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(read_documents(spark, sf_dir))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_nn_descent, op3_jaccard_join, op4_fingerprints, op5_lm_scoring, op6_mixing, op7_quality, op8_licences, op9_packing, op10_language_id)}

#: What SQL can't express, or not in reasonable time, is tested by brute force
#: in tests/llm instead.
ORACLES: dict[str, str] = {"op1_suffix_dedup": sql.OP1, "op3_jaccard_join": sql.OP3, "op6_mixing": sql.OP6}
