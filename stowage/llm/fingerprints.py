"""Operator 4 [native]: threshold-scaled sketches of documents.

A fingerprint holds every distinct shingle hash in the lowest 1/scale of the
hash range. The fraction is fixed, so sketches of any two documents can be
merged and compared, however unequal their lengths: the share of one sketch that
the other has estimates containment, intersection over union estimates Jaccard
similarity. Built-in functions only.

A text without a hash below the threshold keeps its smallest one, so that only
texts without words have an empty sketch. merge() drops such a hash where the
other text has one below the threshold: it always is the sketch of both texts'
shingles. containment() takes only hashes below the threshold into account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column

SCALE = 4
WIDTH = 5
#: Bytes of text in a range of ids, and ranges that percentiles cut at most.
RANGE_BYTES = 32 << 20
COARSE = 256


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Sorted array of the retained hashes. Words are lower-cased; fewer than
    `width` words are one shingle; no words give an empty array. If no hash is
    below the threshold the smallest stays, so only texts without words have an
    empty sketch."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.transform(w, lambda x: F.xxhash64(x))
    return F.transform(F.array(h), lambda a: _shingles(a, width, scale))[0]


def _shingles(h: Column, width: int, scale: int) -> Column:
    """h is evaluated once: it is the lambda's argument."""
    starts = F.when(F.size(h) < width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(h) - width))
    of = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)], F.least(F.size(h), F.lit(width)))
    every = F.transform(starts, of)
    low = F.transform(F.array(every), lambda e: _retained(e, scale))[0]
    return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(low)))


def _below(hashes: Column, scale: int) -> Column:
    return F.filter(hashes, lambda x: x < -(1 << 63) + (1 << 64) // scale)


def _retained(hashes: Column, scale: int) -> Column:
    """Those below the threshold, or else the smallest."""
    return F.when(F.size(_below(hashes, scale)) > 0, _below(hashes, scale)).otherwise(F.array(F.array_min(hashes)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both.cast("double") / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has, by the hashes below the
    threshold. Where a has none there, 1 if b has all of its sketch, else 0."""
    low = _below(a, scale)
    both = F.size(F.array_intersect(low, b)).cast("double")
    return F.when(F.size(low) > 0, both / F.size(low)).otherwise((F.size(F.array_except(a, b)) == 0).cast("double"))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both documents' shingles together."""
    both = F.array_union(a, b)
    return F.when(F.size(both) == 0, both).otherwise(F.array_sort(_retained(both, scale)))


def text_of(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprint(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, sketch, fingerprint of each document."""
    rows = docs.select(column(docs, "doc_id", "bigint"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), sketch(F.col("text"), width, scale).alias("sketch"))
    return rows.withColumn("fingerprint", text_of(F.col("sketch")))


def ranges_of(rows: DataFrame) -> tuple[Column, Column]:
    """(range, place): a number of the range of ids that a row of (doc_id, text)
    is in, rising with the order of with_neighbours(), and the place by which
    rows of one id are ordered. A range has about RANGE_BYTES of text: percentiles
    cut the ids into at most COARSE of them, each of which is cut evenly; an id
    with a mass of rows, or the null ids, by the hash of the text."""
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / COARSE for i in range(1, COARSE)]
    sums = [F.percentile_approx("doc_id", shares, 100_000).alias("p"), F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")]
    r = rows.agg(*sums).first()
    place = F.xxhash64("text")
    if not r.n:
        return F.lit(0).cast("long"), place
    wanted = max(2, least, -(-(r.bytes or 0) // RANGE_BYTES))
    fine = -(-wanted // COARSE)
    step = max(1, COARSE // wanted)
    cuts = (r.p or [])[step - 1 :: step]
    often = {c: cuts.count(c) * fine for c in cuts if cuts.count(c) > 1}
    nulls = max(1, round(wanted * (r.n - r.ids) / r.n))
    stride = fine + max([nulls, *often.values()]) + 1
    bounds = [min((r.hi or 0) + 1, (1 << 63) - 1), *sorted(set(cuts), reverse=True), r.lo or 0]  # from the largest id on
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    dealt = lambda n: F.shiftright((F.shiftright(place, 32) + (1 << 31)) * n, 32)  # noqa: E731  by the hash, over n
    at = F.size(F.filter(array(bounds[1:-1]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    upper, lower = F.get(array(bounds), at).cast("double"), F.get(array(bounds), at + 1).cast("double")
    within = F.least(F.floor((upper - F.col("doc_id")) / F.greatest(upper - lower, F.lit(1.0)) * fine), F.lit(fine - 1)).cast("long")
    if often:
        many = F.try_element_at(F.map_from_arrays(array(often), array(often.values())), F.col("doc_id"))
        within = F.when(many.isNotNull(), fine + dealt(many)).otherwise(within)
    return F.when(F.col("doc_id").isNull(), len(bounds) * stride + dealt(nulls)).otherwise(at.cast("long") * stride + within).cast("long"), place


def with_neighbours(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each document, and of it with its second half replaced by
    the start of the next document in descending order of ids: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    contained_edited, contained_next (share of its shingles that are in the
    edited text, in the next document).

    The order is cut into ranges of ids by bytes of text; each range ends in a
    stand-in for the head of the next one, so no order over all rows is needed.
    After the last document comes the first. Ties of ids go by the text's hash,
    then the text, and an id with a mass of rows is several ranges; null ids come
    last. Null texts are empty; very long texts are one value and are read whole;
    repeated rows follow each other (a mass of rows that are equal in id and text
    stays one range); extra columns are ignored; an empty table gives an empty
    result.
    """
    rows = docs.select(column(docs, "doc_id", "bigint"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    part, place = ranges_of(rows)
    rows = rows.select(part.alias("part"), "doc_id", place.alias("place"), "text")
    # a row per range, without texts: its first document, and the range before; the first one's head follows the last range
    tops = rows.groupBy("part").agg(F.max(F.struct("doc_id", F.bitwise_not("place").alias("place"))).alias("top"))
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    tops = tops.select(F.col("part").alias("p"), F.col("top.doc_id").alias("d"), F.bitwise_not("top.place").alias("h"), before.alias("before"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("place"), F.col("text")]
    # broadcast: some 40 bytes for RANGE_BYTES of text
    heads = rows.join(F.broadcast(tops), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("place") == F.col("h")))
    heads = heads.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("text"))).filter("r = 1")
    stand_in = heads.select(F.col("before").alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("place"), "text", F.lit(1).alias("virtual"))
    all_rows = rows.select("part", "doc_id", "place", "text", F.lit(0).alias("virtual")).unionByName(stand_in)
    all_rows = all_rows.withColumn("sketch", sketch(F.col("text"), width, scale))
    w = Window.partitionBy("part").orderBy("virtual", *order)
    following = all_rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w)).filter("virtual = 0")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = following.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.withColumn("edited_sketch", sketch(F.col("edited"), width, scale))
    own = F.col("sketch")
    return edited.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(own).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(own, F.col("edited_sketch")).alias("near_edited"), likeness(own, F.col("next_sketch")).alias("near_next"),
        containment(own, F.col("edited_sketch"), scale).alias("contained_edited"), containment(own, F.col("next_sketch"), scale).alias("contained_next"),
    )
