"""Suffix-array dedup, Jaccard join, components, fingerprints."""

import hashlib
import random

import brute
import pytest
from conftest import SCHEMA  # noqa: F401
from pyspark.sql import functions as F

from stowage.llm import components, fingerprints, jaccard_join, suffix_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("length", "hot"), [(400, 20_000), (60, 20_000), (60, 1)])
def test_suffix_dedup(docs, rows, length, hot):
    got = of(suffix_dedup.dedup(docs, length, hot, with_text=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix_dedup([r[:2] for r in rows], length), key=repr)


def test_suffix_dedup_periodic_and_random(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 300)))) for i in range(40)] + [(50, "a" * 200), (51, "ab" * 90), (52, "a" * 79)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (20, 40, 80):
        assert of(suffix_dedup.dedup(t, length, with_text=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup(rows, length), key=repr)


@pytest.mark.parametrize(("words", "hot"), [(51, 20_000), (51, 1), (9, 20_000), (9, 1)])
def test_passages(docs, rows, words, hot):
    got = suffix_dedup.remove_passages(docs, words, hot)
    assert of(got, "doc_id", "text", "n_words", "n_removed") == sorted(brute.passages([r[:2] for r in rows], words), key=repr)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_passages_edges(spark, empty):
    """At the beginning, in the middle, at the end, alone; other white space; one
    word fewer; short and long words; repeated rows and null ids."""
    p, q, s = (" ".join(f"{c}{i}" for i in range(51)) for c in ("a", "\u00e9" * 40, "b"))
    rows = [(1, p + " end"), (2, "w  " + p.replace(" ", "\n\t") + "\n y"), (3, "x " + p), (4, p), (5, p.rsplit(" ", 1)[0] + " other"), (6, "one " + q), (7, q + " two"), (8, s), (8, s), (None, s + " three"), (9, "z " * 60), (10, " \u2028 "), (11, None), (12, " " + p)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = of(suffix_dedup.remove_passages(t), "doc_id", "text", "n_words", "n_removed")
    assert got == sorted(brute.passages(rows, 51), key=repr)
    left = {d: x for d, x, *_ in got}
    assert (left[1], left[2], left[3], left[4], left[6], left[7], left[8], left[None]) == ("end", "w  y", "x ", "", "one ", "two", "", "three") and left[5] == rows[4][1]
    assert suffix_dedup.remove_passages(empty).collect() == []


@pytest.mark.parametrize(("least", "hot"), [(30, 20_000), (45, 1), (60, 20_000)])
def test_repeats_shorter_than_what_is_removed(docs, rows, least, hot):
    """Strings of `least` bytes are counted, those of 60 removed."""
    out = suffix_dedup.dedup(docs, 60, hot, with_text=False, least=least)
    assert of(out, "doc_id", "n_repeated", "longest_repeat") == sorted(brute.repeats([r[:2] for r in rows], least), key=repr)
    assert of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup([r[:2] for r in rows], 60), key=repr)


def test_suffix_order_and_range_minima():
    import numpy as np

    r = random.Random(8)
    keys = ["".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(200)]
    order, common = suffix_dedup.suffix_order(keys, 12)
    got = [keys[i] for i in order]
    prefix = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    assert got == sorted(keys) and common.tolist() == [0, *map(prefix, got, got[1:])]
    least = suffix_dedup.RangeMinimum(common)
    a = np.array([r.randrange(199) for _ in range(300)])
    b = np.array([r.randint(x + 1, 200) for x in a.tolist()])
    assert least.of(a, b).tolist() == [common[x:y].min() for x, y in zip(a, b)]


def test_suffix_dedup_of_a_very_long_text(spark):
    """One text of 3 MB that has a passage of another, and itself twice."""
    r = random.Random(6)
    half = "".join(r.choice("abcdefgh ") for _ in range(1_500_000))
    passage = half[700_000:700_500]
    t = spark.createDataFrame([(1, half + "#" + half), (2, "before~~" + passage + "~behind"), (3, "z" * 399)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup(t, with_text=False).collect()}
    assert got == {1: (3_000_001, 3_000_000, 2), 2: (515, 500, 1), 3: (399, 0, 0)}


def test_suffix_dedup_repeated_rows_and_text(spark):
    a, b = "one two three " * 3 + "é" * 40, "unlike all else " * 2
    t = spark.createDataFrame([(1, a), (1, a), (None, b), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, r.text) for r in suffix_dedup.dedup(t, 60).collect()}
    assert got == {(1, len(a.encode()), ""), (None, 0, b), (2, 0, "")}
    assert suffix_dedup.dedup(t, 60).count() == 4


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2), (2, 1, 1)])
def test_jaccard(docs, rows, n, num, den):
    got = of(jaccard_join.jaccard_components(docs, n, num, den), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard([r[:2] for r in rows], n, num, den), key=repr)


def test_jaccard_of_many_near_copies_at_the_threshold(spark):
    """Pairs around the threshold make refusals, which later rounds must go past."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    t = spark.createDataFrame(rows, "doc_id long, text string")
    for args in ((3, 9, 10), (3, 4, 5), (1, 19, 20)):
        assert of(jaccard_join.jaccard_components(t, *args), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows, *args), key=repr)


def test_jaccard_goes_on_where_the_cap_on_partners_left_pairs(spark):
    """One set is refused by all of two groups, in every tile that any two sets share; each set's best partners are in its own group, all linked,
    and the groups are only just linked."""
    import numpy as np

    words = [f"w{i}" for i in range(60_000)]
    hashes = np.array([int(jaccard_join.shingle_set(w.encode(), 1)[0]) for w in words], dtype=np.float64) / 2.0**64
    order = np.argsort(hashes)
    low = [words[i] for i in order if hashes[i] < 0.875]
    high = [words[i] for i in order if hashes[i] >= 0.875]
    spread = lambda k, n: np.linspace(0, n - 1, k).astype(int).tolist()
    common, wide = [low[i] for i in spread(1785, len(low))], len(high) // 135
    # a word of its own for each set in each of 135 pieces of the hash space's last eighth, and words of the groups
    own = lambda v, n=135: [high[b * wide + v] for b in spread(n, 135)]
    rows = [(100 * g + v, " ".join(common + own(25 + g, 80) + own(10 * g + v))) for g in (0, 1) for v in range(10)]
    sid = lambda text: jaccard_join.set_id(jaccard_join.shingle_set(text.encode(), 1))
    least = min(sid(text) for _, text in rows)
    refused = (" ".join(common + own(27) + own(28, 100) + [high[i]]) for i in range(29, len(high), 50))
    rows.append((999, next(text for text in refused if sid(text) < least)))  # the first of each tile
    t = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute.jaccard(rows, 1, 4, 5), key=repr)
    assert {c for _, _, c in want} == {0, 999}
    assert of(jaccard_join.jaccard_components(t, 1, 4, 5), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v"), (None, "lone words stand here alone"), (7, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    assert of(jaccard_join.jaccard_components(t, 5, 4, 5), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows, 5, 4, 5), key=repr)


def test_signatures_share_a_tile_whenever_linked():
    import numpy as np

    r = np.random.default_rng(1)
    bands = jaccard_join.Bands(4, 5)
    for _ in range(300):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(r.integers(0, max(1, len(x) // 5) + 1))
        y = np.unique(np.concatenate([np.delete(x, r.choice(len(x), drop, replace=False)), r.integers(0, 1 << 63, int(r.integers(0, 20))).astype(np.uint64)]))
        if len(y) and bands.linked(len(x), len(y), len(np.intersect1d(x, y))):
            assert set(jaccard_join.signatures(x, bands).tolist()) & set(jaccard_join.signatures(y, bands).tolist())


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en", "a", 1), (2, long, "en", "b", 1), (2, long, "en", "b", 1), (3, long.replace("w30", "z"), "en", "a", 1), (4, "other text of six words here", None, None, None), (4, "other text of six words here", None, None, None), (5, "", None, None, 0), (6, None, None, None, None)]
    got = of(jaccard_join.keep_one(spark.createDataFrame(rows, COLUMNS)), "doc_id")
    assert got == [(1,), (4,), (5,), (6,)]


def test_keep_one_of_repeated_and_null_ids(spark):
    """A row goes by itself, not with its id; null ids and texts of one id are one group's rows too."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (5, a), (5, "a clean text that nothing else is like"), (None, b), (None, b.replace("b30", "z")), (None, b.replace("b31", "z")), (7, "p q r s t u v"), (7, "P q r s t u v"), (None, "p q r s t u v")]
    got = of(jaccard_join.keep_one(spark.createDataFrame([(*r, None, None, None) for r in rows], COLUMNS)), "doc_id", "text")
    assert len(got) == 4 and {(1, a), (5, rows[2][1])} <= set(got) and [d for d, _ in got].count(7) == 1 and [d for d, _ in got].count(None) == 1


def test_empty_tables(empty):
    assert suffix_dedup.dedup(empty).collect() == []
    assert jaccard_join.jaccard_components(empty).collect() == []
    assert jaccard_join.keep_one(empty).collect() == []
    assert fingerprints.with_neighbours(empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5), (1, 0)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys([*range(41), 100], 0), 200: 200, 201: 200}


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.with_neighbours(docs).collect()}
    order = sorted(((d, t or "") for d, t, *_ in rows), reverse=True)
    want = dict(brute.edited(order))
    assert got.keys() == want.keys()
    following = {order[i][0]: order[(i + 1) % len(order)][0] for i in range(len(order))}
    by_text = {}
    for d, t in order:
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(want[d].encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        nxt = got[following[d]]
        one, two = ({f[i : i + 16] for i in range(0, len(f), 16)} for f in (r.fingerprint, nxt.fingerprint))
        assert r.near_next == pytest.approx(len(one & two) / len(one | two) if one | two else 1.0)


def test_sketch_estimates(spark):
    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(1000))
    t = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = t.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.containment(F.col("b"), F.col("a")), fingerprints.containment(F.col("a"), F.col("b")), (fingerprints.merge(F.col("a"), F.col("b")) == F.col("a"))).first()
    assert abs(r[0] - 0.25) < 0.05 and r[1] == 1.0 and abs(r[2] - 0.25) < 0.05 and r[3]


def test_one_document_is_its_own_next(spark):
    r = fingerprints.with_neighbours(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


@pytest.mark.parametrize("copies", [6, 20])
def test_jaccard_bridges_between_groups_of_near_copies(spark, copies, monkeypatch):
    """Groups of near copies that only one text links, more of them than a set emits at first; and tiles cut into many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r = random.Random(copies)
    base = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    swap = lambda w, k, tag: " ".join(f"{tag}{i}" if i in k else x for i, x in enumerate(w))
    rows, far = [], set(range(100, 121))
    for v in range(copies):
        rows.append((100 + v, swap(base, {v}, f"b{v}-")))
        rows.append((200 + v, swap(base, far | {30 + v}, "far-")))
        rows.append((300 + v, swap(other, {r.randrange(200)}, f"o{v}-")))
    rows.append((1, swap(base, set(range(100, 110)), "far-")))
    for args in ((1, 9, 10), (1, 4, 5)):
        t = spark.createDataFrame(rows, "doc_id long, text string")
        assert of(jaccard_join.jaccard_components(t, *args), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(rows, *args), key=repr)


def test_bitmaps_bound_overlaps_at_any_width():
    import numpy as np

    r = np.random.default_rng(4)
    for n in (1, 40, 700, 5000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], r.integers(0, 1 << 63, n).astype(np.uint64)]))
        a, b = jaccard_join.bitmap(x), jaccard_join.bitmap(y)
        width = min(len(a), len(b)) // 8
        differ = int(np.bitwise_count(jaccard_join.folded(a, width) ^ jaccard_join.folded(b, width)).sum())
        assert differ <= len(np.setxor1d(x, y)) and (jaccard_join.folded(b, 8) == jaccard_join.folded(jaccard_join.folded(b, width).tobytes(), 8)).all()


def test_tiles_of_several_sets_are_found_across_batches():
    import pyarrow as pa

    rows = [(1, 5), (2, 3), (2, 3), (2, 9), (2, 9), (2, 11), (3, 4), (4, 1), (4, 2), (5, 7), (5, 7)]
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows[i : i + size]]), pa.array([s for _, s in rows[i : i + size]])], names=["tile", "sid"]) for i in range(0, len(rows), size)]
        got = sorted(r for b in jaccard_join._shared(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns)))
        assert got == [(2, 3, 3), (2, 3, 9), (2, 3, 11), (4, 1, 1), (4, 1, 2)]


def test_fingerprints_of_repeated_and_null_ids_over_many_ranges(spark, monkeypatch):
    """A third of the rows has one id, many have none; ranges are far smaller than these groups."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 500)
    monkeypatch.setattr(fingerprints, "COARSE", 8)
    r = random.Random(2)
    say = lambda i: " ".join(r.choice("one two three four five six".split()) for _ in range(r.randint(0, 30))) + f" {i}"
    rows = [(7, say(i)) for i in range(120)] + [(r.randrange(-500, 500), say(i)) for i in range(150)] + [(None, say(i)) for i in range(60)] + [(7, "the same"), (7, "the same"), (None, None), (9000, "x")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    part, _ = fingerprints.ranges_of(t.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert t.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id").select(part.alias("p")).distinct().count() > 15
    keyed = t.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [(x.doc_id, x.text) for x in sorted(keyed, key=lambda x: (x.doc_id is None, -(x.doc_id or 0), x.h, x.text))]
    want = sorted(((d, len(x), hashlib.sha256(e.encode()).hexdigest()) for (d, x), (_, e) in zip(order, brute.edited(order))), key=repr)
    assert of(fingerprints.with_neighbours(t), "doc_id", "n_chars", "edited_sha256") == want


def test_merged_sketches_are_those_of_the_union(spark):
    r = random.Random(3)
    rows = [(" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(0, 9))), " ".join(f"w{r.randrange(40)}" for _ in range(r.randint(0, 9)))) for _ in range(150)]
    t = spark.createDataFrame(rows, "a string, b string").select(*(fingerprints.sketch(F.col(c), 1).alias(c) for c in "ab"), fingerprints.sketch(F.concat_ws(" ", "a", "b"), 1).alias("c"))
    assert t.filter(fingerprints.merge(F.col("a"), F.col("b")) != F.col("c")).count() == 0
    low, high = t.select(F.min(fingerprints.containment(F.col("a"), F.col("c"))), F.max(fingerprints.containment(F.col("a"), F.col("b")))).first()
    assert 0 <= low and high <= 1
