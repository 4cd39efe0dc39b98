"""Candidate selection: route, decide, take the smallest accepted one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import columns as C
from stowage.functions import constants as K


def attempted(files: DataFrame, policy: K.Policy = K.POLICY) -> DataFrame:
    """Files that are large enough for candidates."""
    return files.filter(F.col("size") >= policy.tiny_bytes)


def routed(files: DataFrame, overlay: bool = False) -> DataFrame:
    """A row per (file, candidate): needs kind, ext, size; adds route, pos,
    strategy. Files without candidates have no rows."""
    named = files.withColumn("route", C.route(F.col("kind"), F.col("ext"), F.col("size")))
    lists = C.candidates(F.col("route"))
    if overlay:
        lists = C.overlay_candidates(F.col("ext"), F.col("size"), lists)
    return named.select("*", F.posexplode(lists).alias("pos", "strategy"))


def decide(candidates: DataFrame, policy: K.Policy = K.POLICY) -> DataFrame:
    """Adds the reason of the benefit and cost cascade."""
    return candidates.withColumn("reason", C.policy_reason(F.col("baseline"), F.col("baseline"), F.col("candidate"), F.col("seconds"), F.col("sha_ok"), policy))


def select_best(decided: DataFrame, *more: Column) -> DataFrame:
    """Per file the smallest accepted candidate, ties to the first measured;
    without one the baseline. One aggregate with map-side sums: no sort, no
    window, no join back. `more` are further aggregates of a file, by alias."""
    size = F.when(F.col("reason") == "ACCEPTED", F.struct(F.col("candidate").alias("c"), F.col("pos").alias("p"), F.col("strategy").alias("s")))
    best = decided.groupBy("file").agg(F.max("baseline").alias("baseline"), F.min(size).alias("w"), F.count("*").alias("measured"), *more)
    own = [c for c in best.columns if c not in ("file", "baseline", "measured", "w")]
    saved = F.col("baseline") - F.col("selected_bytes")
    return (
        best.select("file", "baseline", "measured", F.coalesce("w.s", F.lit("baseline_zip")).alias("selected"), F.coalesce("w.c", F.col("baseline")).alias("selected_bytes"), F.col("w").isNull().alias("used_fallback"), *own)
        .withColumn("saved_bytes", saved)
        .withColumn("saved_percent", F.round(F.when(F.col("baseline") == 0, 0.0).otherwise(100.0 * saved / F.col("baseline")), 3))
    )


def latch(samples: DataFrame, key: str, order: list[str], share: str, gate: K.Gate = K.GATE) -> DataFrame:
    """Hysteresis: on at the high mark, off at the low mark, held between; off
    at first. Runs per key."""
    mark = F.when(F.col(share) >= gate.latch_high, True).when(F.col(share) <= gate.latch_low, False)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("latched", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def cached_decisions(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Looks decisions up by (size, sha256): hit, negative_hit (known to have
    none) or miss."""
    known = results.groupBy("size", "sha256").agg(F.max("strategy").alias("strategy"), F.lit(True).alias("known"))
    out = requests.join(known, ["size", "sha256"], "left")
    return out.withColumn("outcome", F.when(F.col("known").isNull(), "miss").when(F.col("strategy").isNull(), "negative_hit").otherwise("hit")).drop("known")
