"""Operator 6: mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. A source takes all its words a whole
number of times, and of the documents with hashes below a threshold once more.
The threshold is found by histograms: words summed by source and the hash's
first 12 bits give the bucket in which the budget is reached; only that bucket
is summed by the next 12 bits, and so on. Nothing is sorted, thresholds of
smaller budgets are nested in those of larger ones, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, discard, documents, materialize

BITS = 12
LEVELS = 5
WEIGHTS = (3, 1, 2)


def targets(sizes: list[tuple], share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> list[tuple]:
    """(source, size, target): weights deal out share * all sizes; a target
    stops at most * size, and the excess is dealt out again by weight.
    sizes: (source, size), ordered by code point, null last."""
    budget = share * sum(n for _, n in sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float] = [0.0] * len(sizes)
    left = [i for i, (_, n) in enumerate(sizes) if n > 0]
    while left:
        total = sum(w[i] for i in left)
        stop = [i for i in left if budget * w[i] / total > most * sizes[i][1]]
        if not stop:
            for i in left:
                out[i] = budget * w[i] / total
            break
        for i in stop:
            out[i] = most * sizes[i][1]
            budget -= out[i]
        left = [i for i in left if i not in set(stop)]
    return [(s, n, t) for (s, n), t in zip(sizes, out)]


def _digit(level: int) -> Column:
    return F.shiftright("h", BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)


def plan_of(sums: DataFrame, share: float, most: float, weights: tuple) -> DataFrame:
    """targets() over a table of sources (source, n): adds target. The sources in
    the order of size by weight are those that stop, up to one; from there on
    all have the same share of their weight. Windows go over one row a source."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    t = sums.withColumn("w", w)
    by = Window.orderBy("ratio", F.asc_nulls_last("source"))
    live = t.filter("n > 0").withColumn("ratio", F.lit(float(most)) * F.col("n") / F.col("w")).withColumn("p", F.row_number().over(by))
    stopped = F.coalesce(F.sum(F.lit(float(most)) * F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    budget = F.lit(float(share)) * F.sum("n").over(Window.partitionBy())
    live = live.withColumn("level", (budget - stopped) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    cut = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("p", "level"))).over(Window.partitionBy())
    live = live.withColumn("cut", cut).withColumn("target", F.when(F.col("p") >= F.col("cut.p"), F.col("w") * F.col("cut.level")).otherwise(F.lit(float(most)) * F.col("n")))
    return live.select("source", "n", "target").unionByName(t.filter("n = 0").select("source", "n", F.lit(0.0).alias("target")))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """The columns of documents, and size, source_size, target, copies (times
    the mix takes the document, 0 to `most` rounded up), taken (its words).

    Sources may be many: the plan is a table of one row a source, which is
    joined; nothing of it comes to the driver. Of the boundary bucket documents
    are taken up to the last whose words bring the source nearer its target.
    Null texts have size 0; null sources are one source, the last; rows that
    repeat an id and text share a hash and are taken together; ties of hashes at
    the boundary are taken together or not at all, whichever is nearer; very long
    texts count whole; extra columns are ignored; an empty table gives an empty
    result; sources without words have target 0.
    """
    docs = documents(docs)
    # 60 bits of a hash that SQL has too
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256))
    h = F.conv(F.substring(F.md5(name), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    measured = docs.select("*", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("size"), h.alias("h"))
    slim = materialize(measured.select("source", "size", "h"), "op6-sizes")
    sums = slim.groupBy("source").agg(F.sum("size").cast("long").alias("n"))
    # full rounds, words of the last round still to find (goal), prefix of the hash
    rounds = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0).cast("long")
    plan = plan_of(sums, share, most, weights).withColumn("rounds", rounds).withColumn("goal", F.col("target") - F.col("rounds") * F.col("n"))
    plan = materialize(plan.select("source", "n", "target", "rounds", "goal", F.lit(0).cast("long").alias("prefix"), (F.col("goal") < 1e-9).alias("done")), "op6-plan")
    for level in range(LEVELS):
        open_ = plan.filter("not done").select(F.col("source").alias("s"), "goal", "prefix")
        if open_.isEmpty():
            break
        rows = slim.join(open_, F.col("source").eqNullSafe(F.col("s")))
        if level:
            rows = rows.filter(F.shiftright("h", BITS * (LEVELS - level)) == F.col("prefix"))
        histogram = rows.groupBy("source", "goal", _digit(level).alias("bucket")).agg(F.sum("size").alias("b"), F.count("*").alias("c"))
        running = histogram.withColumn("upto", F.sum("b").over(Window.partitionBy("source").orderBy("bucket")))
        # the bucket in which the goal is reached: one row a source
        bound = running.filter("upto > goal and upto - b <= goal").groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bucket", "b", "c", "upto")).alias("f"))
        left = F.col("goal") - (F.col("f.upto") - F.col("f.b"))
        prefix = F.col("prefix") * (1 << BITS) + F.col("f.bucket")
        # what is left shares a hash: it is taken if that is nearer
        last = (F.col("f.c") == 1) | F.lit(level == LEVELS - 1)
        ends = (prefix + F.when(2 * left >= F.col("f.b"), 1).otherwise(0)) * (1 << BITS * (LEVELS - 1 - level))
        found = F.col("f").isNotNull() & ~F.col("done")
        old = plan
        moved = old.join(bound, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "n", "target", "rounds", F.when(found, left).otherwise(F.col("goal")).alias("goal"),
            F.when(found & last, ends).when(found, prefix).otherwise(F.col("prefix")).alias("prefix"), (F.col("done") | ~found | last).alias("done"),
        )
        plan = materialize(moved, "op6-plan")
        discard(old)
    chosen = plan.select(F.col("source").alias("s"), F.col("n").alias("source_size"), "target", "rounds", F.col("prefix").alias("below"))
    out = measured.join(chosen, F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("rounds") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    out = out.withColumn("copies", F.least(copies, F.lit(int(-(-most // 1)))))
    return out.select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken. Documents without
    words cost nothing and stay once."""
    kept = mix(docs, **options)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    return kept.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select("doc_id", "text", "lang", "source", "n_chars")
