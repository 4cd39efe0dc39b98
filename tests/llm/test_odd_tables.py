"""Every operator on tables with nulls in any column, empty and very long texts,
repeated rows and ties, and columns with the operators' own names."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.llm import fingerprints, jaccard_join, language_id, licences, lm_scoring, mixing, neighbours, packing, quality, suffix_dedup

CLASHING = ["k", "k2", "raw", "key", "hash", "sid", "n", "bits", "label", "part", "place", "size", "h", "s", "u", "t", "m", "z", "front", "word", "c", "held_out", "score", "copies", "component_id", "rank"]


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(12)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(60_000))
    rows = [(1, "", "en", "a", 0), (2, " \t\n", None, "a", 3), (3, None, "de", None, None), (None, None, None, None, None), (None, "a text without an id", "en", "b", 20)]
    rows += [(4, "the same row three times over mit license", "en", "b", 41)] * 3 + [(4, "its id with another text", "fr", None, 24)]
    rows += [(5, long, "de", "c", len(long)), (6, long[:200_000] + " x", "de", "c", 200_002), (7, "y" * 150_000, None, "c", 150_000), (8, "\x00​\U0001f600 ok", "en", "", 5), (-9, "Mit License: MIT", "en", "a", 16)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return t.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (5, 1, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int").withColumn("u", F.lit(1))


OPERATORS = {
    "op1": lambda spark, t: suffix_dedup.dedup(t, with_text=False),
    "op3": lambda spark, t: jaccard_join.jaccard_components(t, 3, 9, 10),
    "op4": lambda spark, t: fingerprints.with_neighbours(t),
    "op5": lambda spark, t: lm_scoring.score(t),
    "op6": lambda spark, t: mixing.mix(t).drop("text"),
    "op7": lambda spark, t: quality.classify(t, _labels(spark)),
    "op8": lambda spark, t: licences.scan(t),
    "op10": lambda spark, t: language_id.identify(t),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_a_row(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    ids = lambda rows: sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    assert ids(got) == ids(odd.select("doc_id").collect())
    if name != "op4":  # there, the last of three has another neighbour
        same = [tuple(r) for r in got if r.doc_id == 4]
        assert max(map(same.count, same)) >= 3
    again = OPERATORS[name](spark, odd.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_packing_of_odd_texts(spark, odd):
    got = packing.pack_documents(odd).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("want")).collect()
    assert len(got) == odd.select("doc_id").distinct().count() and all(r.n == r.want for r in got)


def test_neighbours_among_repeated_vectors_and_clashing_columns(spark):
    rows = [(i % 60, [1.0, float(i % 3), 0.5]) for i in range(180)] + [(50, [1.0, 2.0, 0.5])] * 20 + [(61, None), (None, [1.0, 1.0, 1.0]), (62, []), (63, [0.0, 0.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("node", "q", "s", "u", "vec", "ids", "rank", "score", "query_id", "block")])
    got = neighbours.search(t).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank) for r in got] == [(q, i) for q in (0, 50) for i in range(1, 6)]
    # copies of the query's own vector, the smallest ids first
    assert [r.vec_id for r in got if r.query_id == 0] == [3, 6, 9, 12, 15] and all(r.score == pytest.approx(1.0) for r in got)
