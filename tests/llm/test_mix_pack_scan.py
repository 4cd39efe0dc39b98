"""Mixing, packing, licences, the pipeline, the registration."""

import importlib
import sys
import zlib
from collections import defaultdict

import brute
import pytest

from stowage.llm import licences, mixing, packing


def test_targets():
    # weights 3, 1, 2, 3 over 450: all shares, then a, c and d stop at 200 and b has the rest
    t = mixing.targets([("a", 100), ("b", 100), ("c", 100), (None, 0)])
    assert [x[2] for x in t] == pytest.approx([200, 50 + 100 / 3, 100 + 200 / 3, 0])
    assert sum(x[2] for x in t) == pytest.approx(450)
    assert mixing.targets([]) == []


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).toPandas()
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.groupby("source").agg(total=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert (by.total == by.source_size).all()
    assert ((by.taken - by.target).abs() <= by.largest).all()
    assert by.target.sum() == pytest.approx(1.5 * by.total.sum())
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_mixing_thresholds_are_nested(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = {r.doc_id for r in mixing.mix(docs, share=0.2).filter("copies > 0").collect()}
    more = {r.doc_id for r in mixing.mix(docs, share=0.4).filter("copies > 0").collect()}
    assert few and few < more


def test_mixing_of_many_sources(spark):
    """The table of sources is dealt out as the plain version does; ties of hashes go together."""
    import random

    r = random.Random(7)
    rows = [(i, " ".join("w" * r.choice([0, 1, 5, 40])), "x", None if i % 50 == 0 else f"host{r.randrange(60)}", 1) for i in range(600)] + [(9, "same row here", "x", "host1", 1)] * 30
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    plan = {s: (n, t) for s, n, t in mixing.targets(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or "")))}
    assert len(got) == len(rows) and all((r.source_size, r.target) == (plan[r.source][0], pytest.approx(plan[r.source][1])) for r in got)
    assert len({r.copies for r in got if r.text == "same row here"}) == 1
    largest = max(r.size for r in got)
    for s, (_, t) in plan.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= max(largest, 90 if s == "host1" else 0)


def test_mixing_edges(docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count() and all(r.taken <= 2 * r.size for r in out)
    assert mixing.mix(empty).collect() == []
    kept = mixing.mixed_documents(docs)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == sum(r.copies if r.size else 1 for r in out)


def _pieces(df):
    return df.toPandas()


def test_packing(docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = _pieces(packing.pack_documents(docs, limits=(256, 40, 256)))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x, *_ in rows}
    import numpy as np

    for d, p in got.groupby("doc_id"):
        p = p.sort_values("start")
        assert (p.doc_tokens == len(ids[d])).all()
        assert p.start.tolist() == [0, *p.length.cumsum().tolist()[:-1]] and p.length.sum() == len(ids[d])
        for s, n, c in zip(p.start, p.length, p.ids_crc32):
            assert c == zlib.crc32(np.array(ids[d][s : s + n], "<u4").tobytes())
    assert set(got.doc_id) == set(ids)
    padded = 0
    for _, p in got.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert p.offset.tolist() == [0, *p.length.cumsum().tolist()[:-1]] and p.length.sum() <= 256 and len(p) <= 40
        n = int(p.length.sum())
        padded += n if n & (n - 1) == 0 else 256
    assert got.length.sum() / padded > 0.97


def test_special_strings_are_plain_text(spark):
    got = packing.pack_documents(spark.createDataFrame([(1, "<|endoftext|>"), (None, None), (1, "")], "doc_id long, text string")).collect()
    sizes = sorted((r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0)
    assert sizes[:2] == [(0, 1), (1, 1)] and sizes[2][1] > 2  # no single special id
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_vector_limits(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.randint(1, 100), 0) for i in range(300)]
    rows = [(i, n, r.randint(0, n)) for i, n, _ in rows] + [(900, 101, 5), (901, 50, 61), (902, None, None)]
    t = spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long").repartition(2)
    got = {r.example_id: r for r in packing.pack_examples(t, limits=(100, 4, 60)).collect()}
    assert len(got) == len(rows)
    size = {i: (n or 0, k or 0) for i, n, k in rows}
    bins = defaultdict(list)
    for i, r_ in got.items():
        if r_.sequence_id is None:
            assert size[i][0] > 100 or size[i][1] > 60
        else:
            bins[r_.sequence_id].append(i)
    for b in bins.values():
        assert sum(size[i][0] for i in b) <= 100 and len(b) <= 4 and sum(size[i][1] for i in b) <= 60
    least = max(sum(n for n, k in size.values() if n <= 100 and k <= 60) / 100, sum(k for n, k in size.values() if n <= 100 and k <= 60) / 60, len(got) / 4)
    assert len(bins) <= 1.25 * least + 2


def test_conversations(spark):
    t = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "hi"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.example_id: (r.tokens, r.loss_tokens) for r in packing.conversations_as_examples(t).collect()}
    assert got[1][0] > got[1][1] > 0 and got[2] == (1, 0)


def test_licence_base(docs, rows, spark):
    more = [(200, "The MIT License, mit license; see the Apache-License. GNU General Public License v3"), (201, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nmore"), (202, "license: GPL-2.0-only WITH Classpath-exception-2.0"), (203, "License: see below"), (204, "SPDX-License-Identifier: MIT AND ("), (205, "general public general public license license")]
    t = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in licences.scan(t).collect()}
    for d, x in [*(r[:2] for r in rows), *more]:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licence_base(x), d
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[201].labels == "apache,bsd,mit" and got[201].expressions == ["bsd-3-clause and mit or apache-2.0 and bsd-3-clause"]
    assert got[202].labels == "gpl" and got[203].labels == "" and got[204].labels == "mit"


def test_labels_by_a_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = [(-1, "License: Artistic-2.0 or postgresql"), (-2, "licence: own-1 and version 2.0"), (-3, "the Boost Software License and GNU Library General Public License"), (-4, "x" * 400_000 + " mit license"), (-5, None), (-6, "license: mit license: apache-2.0")]
    t = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r.labels for r in licences.scan(t).collect()}
    notices = {**licences.BASE, **licences.NOTICES}
    assert got == {r.doc_id: brute.licence_labels(r.text, notices, licences.label, licences.expression) for r in t.collect()}
    assert (got[-1], got[-2], got[-3], got[-4]) == ("artistic,postgresql", "", "bsl,gpl,lgpl", "mit")


def test_long_expressions_are_read_whole():
    scan = licences.Scanner().scan
    many = " or ".join(f"own-{i}" for i in range(150))
    for text in (f"license: (mit or {many}) and bsd-3-clause", f"license: ({many} or mit) and bsd-3-clause", f"license: mit and (own-1 or {' ' * 3000}bsd-2-clause)"):
        assert scan(text.encode())[5] == "bsd,mit" and scan(text.encode())[6] > 0
    assert scan(f"license: mit or {many}\nend".encode())[7] == [f"mit or {many}"]
    both = " and ".join(f"(mit or own-{i})" for i in range(9))
    assert scan(f"license: {both} and gpl-2.0 with (a or isc)".encode())[5:] == ("gpl,mit", 0.5, [f"{both} and gpl-2.0 with (a or isc)"])


def test_shunting_yard():
    assert licences.postfix(["a", "or", "b", "and", "c"]) == ["a", "b", "c", "and", "or"]
    assert licences.postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    for bad in (["a", "b"], ["and"], ["(", "a"], ["a", ")"], ["a", "or"], []):
        assert licences.postfix(bad) is None
    assert licences.evaluate(licences.postfix(["a", "with", "x", "or", "b"])) == [frozenset({"a with x"}), frozenset({"b"})]


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    before = docs.select(columns)
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == columns, name
        rows = after.collect()
        if name == "language_id":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in rows} == {r.doc_id for r in before.collect() if not any(c.isalpha() for c in r.text or "")}
        if name == "jaccard_join":
            groups = brute.jaccard([(r.doc_id, r.text) for r in before.collect()], 5, 4, 5)
            assert sorted(r.doc_id for r in rows) == sorted(d for d, n, c in groups if not n or d == c)
        if name == "suffix_dedup":
            want = {d: n - k for d, n, k, *_ in brute.suffix_dedup([(r.doc_id, r.text) for r in before.collect()], 400)}
            assert all(0 <= want[r.doc_id] - len(r.text.encode()) <= 6 for r in rows) and len(rows) == len(want)
        if name == "mixing":
            taken = {r.doc_id: r.copies if r.size else 1 for r in __import__("stowage.llm.mixing", fromlist=["mix"]).mix(before).collect()}
            assert len(rows) == sum(taken.values())
        before = spark.createDataFrame(rows, docs.select(columns).schema)
    packed = P.STAGES[-1][1](spark, before, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}
    assert P.run(spark, sf).count() > 0


def test_pipeline_removes_passages_of_over_50_words(spark):
    """They repeat across documents and are shorter than 400 bytes; 50 words stay."""
    import corpus_pipeline as P

    own = lambda c: " ".join(f"{c}{i}" for i in range(200))
    passage, shorter = (" ".join(f"{c}{i:03d}" for i in range(n)) for c, n in (("p", 51), ("q", 50)))
    assert len(passage) < 400
    rows = [(1, f"{own('a')} {passage} {own('b')}"), (2, f"{own('c')}\n{passage}\n{own('d')}"), (3, f"{own('e')} {shorter} {own('f')}"), (4, f"{own('g')} {shorter}")]
    t = spark.createDataFrame([(d, x, "en", "s", len(x)) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        t = stage(spark, t, "")
        if name == "suffix_dedup":
            break
    got = {r.doc_id: r.text for r in t.collect()}
    assert got == {1: f"{own('a')} {own('b')}", 2: f"{own('c')}\n{own('d')}", 3: rows[2][1], 4: rows[3][1]}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_entry_where_a_module_is_missing(monkeypatch):
    """A library that the operators need isn't there: the archive queries stay."""
    for name in [m for m in sys.modules if m.startswith("stowage.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    e = importlib.import_module("__spark_entry__")
    assert "q_select_best" in e.queries() and not any(q.startswith("op") for q in e.queries())
    sys.modules.pop("__spark_entry__", None)


def test_entry_without_the_package(monkeypatch):
    """The archive queries stay when the folder and the pipeline are gone."""
    import importlib.util as u

    real = u.find_spec
    monkeypatch.setattr(u, "find_spec", lambda n, *a: None if n.startswith(("stowage.llm", "corpus_pipeline")) else real(n, *a))
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert "q_select_best" in e.queries() and not any(q.startswith("op") for q in e.queries())
    sys.modules.pop("__spark_entry__", None)
