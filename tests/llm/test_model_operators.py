"""Neighbours, language models, language ID, quality."""

import math
import zlib

import brute
import numpy as np
import pytest

from stowage.llm import common, language_id, lm_scoring, neighbours, quality


def test_neighbours(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(600, 16))
    v[10:40] = v[10]  # copies
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(1000, None), (1050, [0.0] * 16), (1100, [1.0] + [None] * 15), (1150, [float("nan")] * 16), (1200, [1.0, 2.0]), (None, [1.0] * 16)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(t, every=50, k=5).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -9
        best = sorted(range(600), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, s[mine.vec_id.to_numpy()])
        hit += len(set(best) & set(mine.vec_id))
        total += 5
    assert hit / total >= 0.9
    assert set(got.query_id) == set(range(0, 600, 50))  # nothing is near a vector of two components


def test_graph_goes_on_until_its_links_are_still(spark):
    """Narrow first lists take more than two rounds."""
    v = np.random.default_rng(4).normal(size=(1500, 12))
    t = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    nodes = common.materialize(neighbours.nodes_of(t, 2), "test-nodes")
    node = {r.ids[0]: r.node for r in nodes.select("node", "ids").collect()}
    got = {(r.a, r.b) for r in neighbours.build_graph(nodes, k=10, lists=3, block=8, reverse=10).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :6]
    assert np.mean([(node[i], node[j]) in got for i in range(1500) for j in best[i].tolist()]) > 0.85


def test_neighbours_of_few_and_none(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 0.1]), (8, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.rank) for r in neighbours.search(t).orderBy("rank").collect()] == [(8, 1), (7, 2)]
    assert neighbours.search(t.filter("vec_id < 0")).collect() == []


def test_lattice_sums_all_segmentations():
    pieces = {b" ": 0.1, b"a": 0.2, b"b": 0.1, b"ab": 0.25, b" a": 0.05, b"aba": 0.1, b" ab": 0.2}
    lattice = lm_scoring.Lattice({k: math.log(v) for k, v in pieces.items()})
    words = [b"ab", b"abab", b"aaba", b"b"]
    got = lattice.log_probabilities(words)
    for w, x in zip(words, got):
        assert x == pytest.approx(math.log10(brute.segmentations(b" " + w, pieces)))
    # expected counts: bytes of the pieces used make up the words
    e = lattice.expected(words, np.ones(len(words)))
    assert sum(len(p) * c for p, c in zip(lattice.pieces, e)) == pytest.approx(sum(len(w) + 1 for w in words))


@pytest.mark.parametrize("head", [100_000, 5])
def test_lm_scores(docs, rows, head):
    want = brute.lm_base([r[:2] for r in rows])
    got = {r.doc_id: r for r in lm_scoring.score(docs, head=head).collect()}
    assert got.keys() == want.keys()
    for d, (held, n, known, train, base) in want.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert -1e9 < r.score < 0


def test_lm_head_size_changes_nothing(docs):
    a = {r.doc_id: r.score for r in lm_scoring.score(docs).collect()}
    b = {r.doc_id: r.score for r in lm_scoring.score(docs, head=3).collect()}
    assert a == pytest.approx(b)


def test_lm_of_nothing(empty):
    assert lm_scoring.score(empty).collect() == []


def test_languages(spark, sf):
    t = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify(t).join(t.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(got.doc_id, got.held_out))


def test_language_edges(spark, docs, empty):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for d in (60, 61, 62):
        assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
    assert {r.lang_pred for r in got.values()} <= {"en", "fr", "und"} and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(empty).collect() == []
    assert language_id.accept(docs).count() == len(got) - 3
    t = spark.createDataFrame([(1, "no labels here", None), (2, "12 34", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(t).collect()} == {"und"}


def test_without_labels_only_texts_without_letters_go(spark):
    t = spark.createDataFrame([(1, "no labels here", None), (2, "12 34", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in language_id.accept(t).collect()] == [1]


def test_all_languages_are_learned_from_whole_texts(spark, monkeypatch):
    words = {f"l{i:03}": f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)} " for i in range(205)}
    rows = [(1000 * n + i, w * 20, lang) for n, (lang, w) in enumerate(words.items()) for i in range(4)] + [(1_000_000 + i, "0123456789 " * 2000 + "öüä " * 20, "zz") for i in range(4)]
    seen = []
    none = language_id.fit([])
    for name in ("fit", "fit_features"):
        monkeypatch.setattr(language_id, name, lambda got, *_: seen.extend(got) or none, raising=False)
    language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for _, lang in seen} == {*words, "zz"}


def test_families_split_close_languages():
    import random

    r = random.Random(1)
    rows = []
    for lang, letters in {"aa": "abcde", "ab": "abcdef", "xx": "uvwxy", "xy": "uvwxyz"}.items():
        rows += [(" ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(40)).encode(), lang) for _ in range(30)]
    m = language_id.fit(rows, link=0.2)
    assert sorted(map(sorted, m.families)) == [["aa", "ab"], ["xx", "xy"]]
    assert np.mean([m.predict(language_id.features(t))[0] == lang for t, lang in rows]) > 0.9


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels).join(labels.selectExpr("doc_id", "quality q", "toxic t"), "doc_id").toPandas()
    clean = got[(got.q == 1) & (got.t == 0)]
    assert clean.keep.mean() > 0.95
    assert got[got.held_out & (got.q == 1) & (got.t == 0)].keep.mean() > 0.85
    assert got[(got.q == 0)].keep.mean() < 0.5
    assert got.score.between(0, 1).all()


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.quality, r.toxic, r.keep) for r in quality.classify(docs, none).collect()} == {(0.5, 0.0, True)}
    some = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 1), (3, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, some).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(empty, some).collect() == []


def test_lm_scores_are_the_recursion(spark, rows):
    """Both scores of every document by plain loops; repeated ids count and are scored each."""
    own = [r[:2] for r in rows if (r[0] % 3 == 0 and r[0] < 60) or 60 <= r[0] < 64] + [(2000, "lone words that nothing else has: zzyzx qwrk"), (2001, "twice"), (2001, "twice")]
    start = {p: math.exp(v) for p, v in lm_scoring.Lattice.of_file(None).score.items()}
    got = lm_scoring.score(spark.createDataFrame(own, "doc_id long, text string"), head=20).collect()
    want = brute.lm_scores(own, start, lm_scoring.END)
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in own)
    assert all((r.score, r.lattice_score) == pytest.approx(want[r.doc_id], abs=1e-6) for r in got)


def test_long_words_are_worked_on_in_blocks(monkeypatch):
    r = np.random.default_rng(3)
    lattice = lm_scoring.Lattice({k: math.log(v) for k, v in {b" ": 0.1, b"a": 0.2, b"b": 0.1, b"ab": 0.25, b" a": 0.05, b"aba": 0.1, b" ab": 0.2}.items()})
    words = [bytes(r.choice([97, 98], n).tolist()) for n in (1, 30, 31, 200, 333)]
    whole, used = lattice.log_probabilities(words), lattice.expected(words, np.arange(1.0, 6.0))
    monkeypatch.setattr(lm_scoring, "LONG", 30)
    assert np.allclose(lattice.log_probabilities(words), whole) and np.allclose(lattice.expected(words, np.arange(1.0, 6.0)), used)


def test_a_very_long_word_is_scored(spark):
    t = spark.createDataFrame([(1, "x" * 300_000 + " and more"), (2, "and more"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(t).collect()}
    assert got[1].n_tokens == 4 and got[1].lattice_score < got[2].lattice_score < 0 and all(math.isfinite(r.score) for r in got.values())


def test_families_of_the_documents_hold_several_languages(spark):
    """The one-versus-one machines decide on the documents, and decide well."""
    t = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit_features(language_id.sample_of(t, 100, 8000))
    assert sorted(map(len, model.families)) == [2, 2] and all(len(p) == 1 for p in model.pairs)
    got = language_id.identify(t, per_lang=100).join(t.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred != 'und'").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.95


def test_families_are_of_bounded_size():
    r = np.random.default_rng(5)
    profiles = r.normal(size=(50, 30))
    profiles /= np.linalg.norm(profiles, axis=1, keepdims=True)
    groups = language_id.families_of(profiles)
    assert sorted(i for g in groups for i in g) == list(range(50)) and max(map(len, groups)) <= 16
    assert [len(language_id.families_of(profiles[:n])) for n in (1, 2, 4)] == [1, 1, 2]


def test_a_text_that_is_repeated_is_one_training_row(spark):
    t = spark.createDataFrame([(1, "ein text", "de")] * 40 + [(i, f"some text {chr(97 + i)}", "en") for i in range(5)], "doc_id long, text string, lang string")
    got = [lang for _, lang in language_id.sample_of(t, 10, 100)]
    assert got.count("de") == 1 and got.count("en") <= 5


def test_quality_learns_from_all_unlabelled_documents(spark):
    """The surest documents of the whole table come, repeated rows once, none that has a label."""
    rows = [(i, f"{'good clear prose' if i % 2 else 'BUY!!! $$$ now'} {i % 7} " * 5, "en", "a", 100) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[300:310] * 20, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    seen = []
    real = quality.CoTraining.give
    try:
        quality.CoTraining.give = lambda self, name, side, found, each: (seen.append([x[0] for x in found]), real(self, name, side, found, each))[1]
        good, toxic = quality.fit(quality.views_of(docs), labels, each=30, sure=0.8)
    finally:
        quality.CoTraining.give = real
    keys = [k for found in seen for k in found]
    assert good and toxic is None and keys and min(d for d, _ in keys) >= 100 and all(len(f) == len(set(f)) for f in seen)
    out = quality.classify(docs, labels).toPandas()
    assert (out[out.doc_id % 2 == 1].quality > 0.5).all() and (out[out.doc_id % 2 == 0].quality < 0.5).all()


def test_recall_where_few_nodes_are_opened(spark):
    """4,000 vectors in clusters, a short pool: each query scores a small share of all."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 24))
    v = centres[r.integers(0, 40, 4000)] + 0.6 * r.normal(size=(4000, 24))
    t = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = neighbours.search(t, every=50, k=5, pool=40, open_=16).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(80), np.arange(0, 4000, 50)] = -9
    best = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([j in set(got[got.query_id == 50 * i].vec_id) for i, row in enumerate(best) for j in row]) >= 0.9


def _clustered(spark, n=4000):
    r = np.random.default_rng(10)
    v = r.normal(size=(40, 24))[r.integers(0, 40, n)] + 0.6 * r.normal(size=(n, 24))
    return v, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")


def test_search_has_no_job_for_each_step(spark):
    """Rounds and walks stay in the tasks; once each step joined all that was seen."""
    _, t = _clustered(spark)
    spark.sparkContext.setJobGroup("op2-steps", "")
    neighbours.search(t, every=50, k=5, pool=40, open_=16).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("op2-steps"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 40


def test_recall_over_many_parts(spark):
    """Each part is searched for each query, and the best of all are the exact ones."""
    v, t = _clustered(spark)
    got = neighbours.search(t, every=50, k=5, most=300).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(80), np.arange(0, 4000, 50)] = -9
    best = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([j in set(got[got.query_id == 50 * i].vec_id) for i, row in enumerate(best) for j in row]) >= 0.97
    assert all(abs(r.score - s[r.query_id // 50, r.vec_id]) < 1e-12 for r in got.itertuples())


def test_graph_of_random_vectors(spark):
    """64 dimensions without clusters, where few nodes of a small leaf are near."""
    u = np.random.default_rng(6).normal(size=(12_000, 64))
    t = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(u)], "vec_id long, embedding array<double>")
    nodes = common.materialize(neighbours.nodes_of(t, 2), "test-nodes")
    node = {r.ids[0]: r.node for r in nodes.select("node", "ids").collect()}
    got = {(r.a, r.b) for r in neighbours.build_graph(nodes).collect()}
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u[::100] @ u.T
    s[np.arange(120), np.arange(0, 12_000, 100)] = -9
    best = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([(node[100 * i], node[j]) in got for i, row in enumerate(best) for j in row.tolist()]) >= 0.95
