"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al. 2014): each step is a group-by on ids, no
vertex's neighbours are ever gathered, and rounds grow with the logarithm of
the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v. Each vertex u links its larger (or smaller)
    neighbours to the smallest vertex m of its neighbours and itself."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id on an edge (a, b): label is the smallest id of
    its component. Loops and repeated edges are ignored; nulls link nothing."""
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    while seen[0]:
        step = materialize(_star(_star(now, True), False), "cc")
        discard(now)
        now, before = step, seen
        seen = print_of(now)
        if tuple(seen) == tuple(before):
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
