"""Inventory of files: typing, validity, duplicates, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import columns as C


def analyze(files: DataFrame) -> DataFrame:
    """files: relpath, content (binary, null if unreadable). Adds extension,
    size_bytes, detected_type, is_binary, extension_mismatch, sha256, valid,
    invalid_reason."""
    ext = C.extension(F.col("relpath"))
    size = F.octet_length("content").cast("bigint")
    kind = F.when(size == 0, "EMPTY").otherwise(C.detect_format(F.col("content"), ext))
    out = files.withColumn("extension", ext).withColumn("size_bytes", size).withColumn("detected_type", kind)
    text = [*set(C.K.TEXT_HINTS.values()), "TEXT_UNKNOWN"]
    reason = F.when(F.col("content").isNull(), "UNREADABLE").when(size == 0, "EMPTY")
    return (
        out.withColumn("is_binary", ~F.col("detected_type").isin(text))
        .withColumn("extension_mismatch", C.extension_mismatch(F.col("detected_type"), F.col("extension")))
        .withColumn("sha256", F.sha2("content", 256))
        .withColumn("invalid_reason", reason)
        .withColumn("valid", F.col("invalid_reason").isNull())
    )


def keep_first(files: DataFrame, key: str = "sha256", order: str = "seq", name: str = "relpath") -> DataFrame:
    """Adds is_duplicate_of: of rows with one key, all but the first in order
    carry the first one's name. Joined by the aggregated key, so a mass of
    copies is no group of one task."""
    first = files.groupBy(key).agg(F.min(F.struct(order, name)).alias("f"), F.count("*").alias("n")).filter("n > 1")
    out = files.join(first.select(key, F.col(f"f.{name}").alias("first_name"), F.col(f"f.{order}").alias("first_seq")), key, "left")
    return out.withColumn("is_duplicate_of", F.when(F.col(order) != F.col("first_seq"), F.col("first_name"))).drop("first_name", "first_seq")


def summary(files: DataFrame) -> DataFrame:
    """Files, bytes, distinct contents and the bytes that duplicates would cost.
    needs size, sha256, valid."""
    good = files.filter("valid").groupBy("sha256").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("one"))
    bad = files.agg(F.count_if(~F.col("valid")).alias("invalid_files"))
    sums = good.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("valid_files"), F.count("*").alias("unique_files"), F.coalesce(F.sum("one"), F.lit(0)).alias("unique_bytes"), F.coalesce(F.sum(F.col("b") - F.col("one")), F.lit(0)).alias("duplicate_bytes"))
    return sums.crossJoin(bad)  # one row each


def remaining(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Files still to do, the smallest first."""
    return files.join(done.select(key), key, "left_anti").orderBy("size", key)
