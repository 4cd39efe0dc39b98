"""Rollups, comparisons and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics_rollup(files: DataFrame) -> DataFrame:
    """Per (file_type, strategy or baseline_zip): sums, savings that don't go
    below 0, saving percent over files with a size, milliseconds.
    files: file_type, strategy, original, stored, ms."""
    percent = 100.0 * (F.col("original") - F.col("stored")) / F.nullif(F.col("original"), F.lit(0))
    g = files.withColumn("p", percent).groupBy("file_type", F.coalesce("strategy", F.lit("baseline_zip")).alias("strategy"))
    return g.agg(
        F.count("*").alias("file_count"), F.sum("original").alias("original_bytes"), F.sum("stored").alias("stored_bytes"), F.greatest(F.sum("original") - F.sum("stored"), F.lit(0)).alias("saved_bytes"),
        F.round(F.avg("p"), 6).alias("avg_saving_percent"), F.round(F.min("p"), 6).alias("min_saving_percent"), F.round(F.max("p"), 6).alias("max_saving_percent"),
        F.round(F.avg("ms"), 6).alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
    )


def per_type_stats(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Two grains, each summed before they meet: files (file_type, baseline,
    selected_bytes, used_fallback; zero sizes count as missing) and candidates
    (file_type, seconds, accepted; null times are 0)."""
    zero = lambda c: F.nullif(F.col(c), F.lit(0))
    f = files.groupBy("file_type").agg(F.count("*").alias("files"), F.coalesce(F.sum(zero("baseline")), F.lit(0)).alias("baseline_bytes"), F.coalesce(F.sum(zero("selected_bytes")), F.lit(0)).alias("selected_bytes"), F.count_if("used_fallback").alias("fallbacks"))
    c = candidates.groupBy("file_type").agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"), F.round(F.avg(F.coalesce("seconds", F.lit(0))), 6).alias("avg_seconds"), F.median(F.coalesce("seconds", F.lit(0))).alias("median_seconds"))
    percent = F.round(100.0 * (F.col("baseline_bytes") - F.col("selected_bytes")) / F.nullif(F.col("baseline_bytes"), F.lit(0)), 6)
    return f.join(c, "file_type", "left").withColumn("weighted_percent", percent)


def top_per_bucket(rows: DataFrame, buckets: dict[str, str], order: list, most: int = 15) -> DataFrame:
    """The first rows of each report list; buckets: name to condition. The limit
    is the report's, each list is cut on its own."""
    out = None
    for name, cond in buckets.items():
        one = rows.filter(cond).orderBy(*order).limit(most).withColumn("bucket", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def explode_candidates(files: DataFrame) -> DataFrame:
    """files: file, skipped, selected, candidates array<struct<strategy, bytes>>.
    Skipped files have one empty row, files without candidates one of the
    baseline; the winner is marked."""
    none = F.array(F.struct(F.lit(None).cast("string").alias("strategy"), F.lit(None).cast("bigint").alias("bytes")))
    base = F.array(F.struct(F.lit("baseline_zip").alias("strategy"), F.col("baseline").alias("bytes")))
    rows = F.when(F.col("skipped"), none).when(F.size(F.coalesce("candidates", F.array().cast("array<struct<strategy:string,bytes:bigint>>"))) == 0, base).otherwise(F.col("candidates"))
    out = files.select("file", "selected", F.explode(rows).alias("c"))
    return out.select("file", "c.strategy", "c.bytes", F.when(F.col("c.strategy") == F.col("selected"), "YES").otherwise("").alias("winner"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Totals over the files measured again; a file without an earlier result
    counts only behind. Both: file, selected_bytes, accepted."""
    b = before.select("file", F.col("selected_bytes").alias("b"), F.col("accepted").alias("bn"))
    return compared_totals(after.join(b, "file", "left"))


def compared_totals(files: DataFrame) -> DataFrame:
    """before_after() of rows that have both: selected_bytes and accepted now, b
    and bn before (null without an earlier result)."""
    return files.agg(F.count("*").alias("files"), F.count("b").alias("seen_before"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes_before"), F.sum("selected_bytes").alias("bytes_after"), F.coalesce(F.sum("bn"), F.lit(0)).alias("accepted_before"), F.sum("accepted").alias("accepted_after"), F.count_if(F.col("selected_bytes") < F.col("b")).alias("improved"))


def worst(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The group with the largest sum, the first by key if several."""
    sums = rows.groupBy(*key).agg(F.sum(value).alias("total"))
    return sums.orderBy(F.desc("total"), *key).limit(1)


def null_if_any_null(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sum per group, null if a value is missing."""
    return rows.groupBy(key).agg(F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(value)).alias("total"))


def latest_before(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each decision with the latest candidate record of its file. Both: file,
    seq; candidates: strategy, bytes; decisions: selected."""
    last = candidates.groupBy("file").agg(F.max_by(F.struct("strategy", "bytes"), "seq").alias("c"))
    return decisions.join(last, "file", "left").select("file", "selected", "c.strategy", "c.bytes")


def share_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds pct of the total, two decimals; needs a row per category."""
    return counts.withColumn("pct", F.round(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy()), 2))
