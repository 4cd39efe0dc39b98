"""Operator 1: removal of long repeated byte strings by prefix-free parsing.

A rolling hash over 16 bytes sets triggers: the leftmost minimum of every run of
SPAN hashes. Where a window of `least` bytes starts decides its trigger, so the
triggers cut a text into phrases and each window belongs to exactly one phrase;
equal windows have equal triggers, wherever they stand. A phrase is kept with
the bytes that windows of `length` bytes reach, so no window crosses its end
(the parse's phrases overlap, which makes the set of them prefix-free).

* Dictionary: the distinct phrases with the number of times the parse has them.
  All windows of a phrase that the parse has twice repeat: no bytes are needed.
* Parse: the bytes right of the triggers, up to `length`, are its suffixes. They
  are dealt out by ranges of their first bytes and sorted in each range, so the
  ranges one after the other are the parse's suffix array, with the common
  prefix (LCP) of each with the one before. Suffixes that share no more than
  the bytes which every window has right of its trigger aren't compared.
* Both combined: a window starts o bytes left of a trigger. The bytes left of
  the triggers, sorted from right to left, give the dictionary's suffixes: for
  each o the phrases with the same o bytes. These in the order of the parse are
  the corpus order of the windows' starts, and o and the smallest LCP between
  two neighbours make the LCP of the corpus. Runs of LCP >= `length` are
  removed; runs of LCP >= `least` are counted as repeated.

Only hashes of phrases are shuffled for all of the corpus, some 36 bytes a
phrase. Bytes are compared only for phrases that share the bytes right of their
trigger with another. Ranges of one beginning with over HOT phrases are counted
by window hashes with map-side sums instead of being gathered in one task.

remove_passages() goes the same way over words: each word is CODE bytes of a
hash, so a passage of w words is a string of w * CODE bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, bytes_of, discard, documents, materialize, mix64, partitions_for

GRAM = 16
HOT = 20_000
CHUNK = 8_000
#: Shortest repeated string that is counted, in bytes.
LEAST = 224
#: Bytes that stand for a word, and the words of a passage: over 50.
CODE = 8
PASSAGE = 51
_ROW = "k long, k2 int"


def span_of(least: int) -> int:
    """Hashes in a run: two runs and a gram fit into a window."""
    span = min(180, (least - GRAM) // 2)
    if span < 1:
        raise ValueError(f"length must be at least {GRAM + 2}")
    return span


def phrases(raw: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each phrase, and its trigger's place."""
    n, span = len(raw), span_of(least)
    if n < least:
        z = np.zeros(0, np.int64)
        return z, z, z
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    base, step = 0x9E3779B97F4A7C15, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2
    low = np.uint64((1 << 31) - 1)
    m = (mix64(h) & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    at = (m[: n - least + 1] & low).astype(np.int64)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo = np.concatenate(([0], cut))
    hi = np.concatenate((cut - 1, [len(at) - 1]))
    return lo, hi, at[lo]


def pack(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, have: np.ndarray) -> np.ndarray:
    """A phrase's place: its trigger, first and last window start, bytes."""
    return (at << 32) | ((at - lo) << 24) | ((at - hi) << 16) | have


def unpack(x: int) -> tuple[int, int, int, int]:
    at = x >> 32
    return at - (x >> 24 & 255), at - (x >> 16 & 255), at, x & 65535


def _keyed(docs: DataFrame) -> DataFrame:
    """k and k2 (96 bits) identify a row by its content: repeated rows share
    them, and each of them counts as a place of its own."""
    row = (F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    return docs.withColumn("k", F.xxhash64(*row)).withColumn("k2", F.hash(F.lit("k2"), *row))


def _phrase_rows(length: int, least: int):
    reach = least - span_of(least) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, more, mids, whole, places = [], [], [], [], []

            def out() -> pa.RecordBatch:
                hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (mids, whole)]
                return pa.RecordBatch.from_arrays([*hashes, pa.array(np.concatenate(keys)), pa.array(np.concatenate(more)), pa.array(np.concatenate(places))], names=["mid", "phrase", "k", "k2", "place"])

            for k, k2, raw in zip(batch.column("k").to_pylist(), batch.column("k2").to_pylist(), batch.column("raw")):
                raw = raw.as_py()
                lo, hi, at = phrases(raw, least)
                if not len(lo):
                    continue
                end = np.minimum(hi + length, len(raw))
                for a, b, p in zip(lo.tolist(), end.tolist(), at.tolist()):
                    mids.append(digest(raw[p : p + reach]))
                    whole.append(digest(raw[a:b], p - a))
                keys.append(np.full(len(lo), k, np.int64))
                more.append(np.full(len(lo), k2, np.int32))
                places.append(pack(lo, hi, at, end - lo))
                if len(mids) > 50_000:
                    yield out()
                    keys, more, mids, whole, places = [], [], [], [], []
            if mids:
                yield out()

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """raw to z, zstd of the bytes: what is shuffled gets smaller."""
    c = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        own = [x for x in batch.schema.names if x != "raw"]
        packed = pa.array([c.compress(x.as_py()) for x in batch.column("raw")], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in own), packed], names=[*own, "z"])


_CONTEXT = pa.schema([("hot", pa.bool_()), ("k", pa.int64()), ("k2", pa.int32()), ("place", pa.int64()), ("once", pa.bool_()), ("front", pa.binary()), ("raw", pa.binary())])


def _contexts(least: int):
    """The bytes around the triggers that are asked for; front: those that every
    window has right of its trigger."""
    reach = least - span_of(least) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [()] * 7, _CONTEXT)], schema=_CONTEXT)
        for batch in batches:
            rows = []
            for k, k2, packed, asked in zip(batch.column("k").to_pylist(), batch.column("k2").to_pylist(), batch.column("z"), batch.column("asked")):
                raw = d.decompress(packed.as_py())
                for x in asked.as_py():
                    lo, _, at, have = unpack(x["place"])
                    rows.append((x["hot"], k, k2, x["place"], x["once"], raw[at : at + reach], raw[lo : lo + have]))
                if len(rows) > 4_000:
                    yield out(rows)
                    rows = []
            yield out(rows)

    return run


def suffix_order(keys: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of byte strings of at most `width` bytes, and the common
    prefix of each with the one before it in that order (0 for the first)."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    m = np.frombuffer(b"".join(keys[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
    size = np.array([len(keys[i]) for i in order])
    common = np.zeros(len(order), np.int64)
    if len(order) > 1 and width:
        other = m[1:] != m[:-1]
        first = np.where(other.any(axis=1), other.argmax(axis=1), width)
        common[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return np.array(order), common


class RangeMinimum:
    """Smallest value of values[a:b] for many a < b at once (a sparse table)."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            x, half = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(x[:-half], x[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for j in np.unique(level).tolist():
            on = level == j
            out[on] = np.minimum(self.rows[j][a[on]], self.rows[j][b[on] - (1 << j)])
        return out


def shared_windows(rows: list[tuple], length: int, least: int) -> list[tuple[int, int, int, int, bool]]:
    """(k, k2, first byte, byte after the last, wide) of runs of windows that
    some other phrase has too; wide runs are of windows of `length`, others of
    `least` bytes. rows: (k, k2, place, once, raw), all phrases of some ranges of
    the parse's order; those that aren't `once` are known to repeat already."""
    n, span = len(rows), span_of(least)
    spot = [unpack(r[2]) for r in rows]
    lefts = [r[4][: at - lo][::-1] for r, (lo, _, at, _) in zip(rows, spot)]
    rights = [r[4][at - lo :] for r, (lo, _, at, _) in zip(rows, spot)]
    left_order, left_common = suffix_order(lefts, span)
    order, common = suffix_order(rights, length)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    smallest = RangeMinimum(common)
    most = np.array([at - lo for lo, _, at, _ in spot])
    first = np.array([at - hi for _, hi, at, _ in spot])
    once = np.array([r[3] for r in rows])
    lcp = np.zeros((n, span), np.int32)  # of the start o bytes left of the trigger with its nearest in corpus order
    alike = np.empty(n, np.int64)
    for o in range(span):
        chosen = order[(first[order] <= o) & (o <= most[order])]
        if len(chosen) < 2:
            continue
        alike[left_order] = np.cumsum(left_common < o)
        by = chosen[np.argsort(alike[chosen], kind="stable")]
        same = alike[by[1:]] == alike[by[:-1]]
        near = np.zeros(len(same), np.int64)
        near[same] = o + smallest.of(rank[by[:-1][same]] + 1, rank[by[1:][same]] + 1)
        lcp[by[1:], o] = near
        lcp[by[:-1], o] = np.maximum(lcp[by[:-1], o], near)
    lcp[~once] = 0
    out = []
    for size, wide in ((length, True), (least, False)) if least < length else ((length, True),):
        marks = lcp >= size
        for i in np.flatnonzero(marks.any(axis=1)).tolist():
            on = np.flatnonzero(np.diff(np.concatenate(([0], marks[i].view(np.int8), [0]))))
            at = spot[i][2]
            for a, b in zip(on[::2].tolist(), on[1::2].tolist()):
                out.append((rows[i][0], rows[i][1], at - (b - 1), at - a + size, wide))
    return out


_SPAN = pa.schema([("k", pa.int64()), ("k2", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("wide", pa.bool_())])
_SPANS = f"{_ROW}, start long, stop long, wide boolean"


def _compare(length: int, least: int):
    """Rows come sorted by front; whole ranges of one front are gathered into
    chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        front = None

        def out() -> pa.RecordBatch:
            c = list(zip(*shared_windows(held, length, least))) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(c, _SPAN)], schema=_SPAN)

        for batch in batches:
            for f, *row in zip(*(batch.column(n).to_pylist() for n in ("front", "k", "k2", "place", "once", "raw"))):
                if len(held) >= CHUNK and f != front:
                    yield out()
                    held = []
                held.append(tuple(row))
                front = f
        if held:
            yield out()

    return run


def _window_hashes(length: int, least: int):
    """One row for each window of the phrases of hot ranges; the hashes of
    windows of one length meet only those of the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, own, starts, wides, onces = [], [], [], [], []
            for k, k2, place, once, raw in zip(*(batch.column(n).to_pylist() for n in ("k", "k2", "place", "once", "raw"))):
                lo, hi, _, have = unpack(place)
                for size in {length, least}:
                    for i in range(min(hi - lo, have - size) + 1):
                        d = xxhash.xxh3_128_intdigest(raw[i : i + size], size)
                        hs.append(d)
                        own.append((k, k2))
                        starts.append(lo + i)
                        wides.append(size == length)
                        onces.append(once)
            high, low = (pa.array([(d >> s & (1 << 64) - 1) - (1 << 63) for d in hs], pa.int64()) for s in (64, 0))
            k, k2 = (pa.array([x[i] for x in own], t) for i, t in ((0, pa.int64()), (1, pa.int32())))
            yield pa.RecordBatch.from_arrays([high, low, k, k2, pa.array(starts, pa.int64()), pa.array(wides, pa.bool_()), pa.array(onces, pa.bool_())], names=["h", "h2", "k", "k2", "start", "wide", "once"])

    return run


def repeated_spans(docs: DataFrame, length: int = 400, hot: int = HOT, least: int = LEAST) -> DataFrame:
    """(k, k2, start, stop, wide): byte ranges, possibly overlapping, that windows
    of `length` (wide) or `least` bytes cover which also start elsewhere. k and k2
    are from _keyed()."""
    return _spans_in(_keyed(docs).select("k", "k2", bytes_of().alias("raw")), length, hot, min(least, length))


def _spans_in(raw: DataFrame, length: int, hot: int, least: int) -> DataFrame:
    """repeated_spans() of any strings: k, k2, raw."""
    raw = raw.filter(F.length("raw") >= least)
    parse = raw.mapInArrow(_phrase_rows(length, least), f"mid long, phrase long, {_ROW}, place long")
    # 1. triggers with bytes to their right that occur once share no window with another
    # (written first: a join of two plain shuffles can split a hot key's rows)
    again = materialize(parse.groupBy("mid").agg(F.count("*").alias("c")).filter("c > 1").select("mid"), "op1-middles")
    parse = materialize(parse.join(again, "mid", "left_semi"), "op1-parse")
    # 2. the dictionary: distinct phrases, how often, and one place each
    book = materialize(parse.groupBy("mid", "phrase").agg(F.count("*").alias("c"), F.min(F.struct("k", "k2", "place")).alias("at")), "op1-book")
    whole = parse.join(book.filter("c > 1").select("mid", "phrase"), ["mid", "phrase"], "left_semi")
    byte = lambda n: F.shiftright("place", n).bitwiseAND(255)
    at, have = F.shiftright("place", 32), F.col("place").bitwiseAND(65535)
    whole = whole.select("k", "k2", (at - byte(24)).alias("start"), F.when(have >= length, at - byte(24) + have).otherwise(at - byte(16) + least).alias("stop"), (have >= length).alias("wide"))
    # 3. those of several phrases: compare their bytes
    several = book.groupBy("mid").agg(F.count("*").alias("n")).filter("n > 1").select("mid", (F.col("n") > hot).alias("hot"))
    asked = book.join(several, "mid").groupBy(F.col("at.k").alias("k"), F.col("at.k2").alias("k2")).agg(F.collect_list(F.struct("hot", F.col("at.place").alias("place"), (F.col("c") == 1).alias("once"))).alias("asked"))
    text = raw.mapInArrow(_squeeze, f"{_ROW}, z binary")
    text = text.join(asked, ["k", "k2"]).groupBy("k", "k2").agg(F.first("z").alias("z"), F.first("asked").alias("asked"))  # a repeated row is asked once
    contexts = materialize(text.mapInArrow(_contexts(least), f"hot boolean, {_ROW}, place long, once boolean, front binary, raw binary"), "op1-contexts")
    cool = contexts.filter("not hot").repartitionByRange(partitions_for(raw.sparkSession), "front").sortWithinPartitions("front").mapInArrow(_compare(length, least), _SPANS)
    windows = contexts.filter("hot").mapInArrow(_window_hashes(length, least), f"h long, h2 long, {_ROW}, start long, wide boolean, once boolean")
    twice = windows.groupBy("h", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h", "h2")
    warm = windows.filter("once").join(twice, ["h", "h2"], "left_semi")
    warm = warm.select("k", "k2", "start", (F.col("start") + F.when(F.col("wide"), length).otherwise(least)).alias("stop"), "wide")
    return whole.unionByName(cool).unionByName(warm)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_OUT = "doc_id long, text string, lang string, source string, n_chars long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, longest_repeat long"


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, numbers, shas = [], [], []
            for packed, found in zip(batch.column("z"), batch.column("spans")):
                raw, found = d.decompress(packed.as_py()), found.as_py() or []
                spans = _merge([(x["start"], x["stop"]) for x in found if x["wide"]])
                covered = [b - a for a, b in _merge([(x["start"], x["stop"]) for x in found])]
                kept, last = [], 0
                for a, b in spans:
                    kept.append(raw[last:a])
                    last = b
                kept = b"".join([*kept, raw[last:]]) if spans else raw
                text = kept.decode("utf-8", "ignore") if with_text else None
                texts.append(text)
                numbers.append((len(text) if with_text else None, len(raw), len(raw) - len(kept), len(spans), sum(covered), max(covered, default=0)))
                shas.append(hashlib.sha256(kept).hexdigest())
            n_chars, n_bytes, n_removed, n_spans, n_repeated, longest = (pa.array(x, pa.int64()) for x in (list(zip(*numbers)) or [()] * 6))
            names = [x.split()[0] for x in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), n_chars, n_bytes, n_removed, n_spans, pa.array(shas, pa.string()), n_repeated, longest], names=names)

    return run


def dedup(docs: DataFrame, length: int = 400, hot: int = HOT, with_text: bool = True, least: int = LEAST) -> DataFrame:
    """Removes every byte covered by a string of `length` bytes that starts
    anywhere else too, in the same document or another; strings are judged on
    the input, overlaps count, matches never cross documents.

    One row per input row: the columns of documents with the remaining text
    (characters that a removal split are left out) and its n_chars, then
    n_bytes, n_removed, n_spans, kept_sha256 of the exact remaining bytes. Then
    n_repeated and longest_repeat: all bytes, and those of the longest run, that
    are covered by strings of `least` bytes (at most `length`) which start
    anywhere else too; these aren't removed unless `length` bytes repeat.
    Without with_text, text and n_chars are null. Null texts count as empty and
    become empty; texts shorter than `least` stay; very long texts are one
    value and are read whole; repeated rows are places of their own, so each
    removes the other; null ids are kept; extra columns are ignored; an empty
    table gives an empty result.
    """
    docs = documents(docs)
    spans = repeated_spans(docs, length, hot, least).groupBy("k", "k2").agg(F.collect_list(F.struct("start", "stop", "wide")).alias("spans"))
    packed = _keyed(docs).select("k", "k2", "doc_id", "lang", "source", bytes_of().alias("raw")).mapInArrow(_squeeze, f"{_ROW}, doc_id long, lang string, source string, z binary")
    return packed.join(spans, ["k", "k2"], "left").select("doc_id", "lang", "source", "z", "spans").mapInArrow(_apply(with_text), _OUT)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """raw from text to CODE bytes a word."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        coded = []
        for raw in batch.column("raw"):
            words = raw.as_py().split()
            coded.append(np.fromiter(map(digest, words), np.uint64, len(words)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("k2"), pa.array(coded, pa.binary())], names=["k", "k2", "raw"])


_CUT = "doc_id long, text string, lang string, source string, n_chars long, n_words long, n_removed long, n_spans long"


def _cut_words(words: int):
    """Spans are of code bytes; those of whole words count, if they are at least
    `words` of them."""
    pattern = re.compile(WORD_PATTERN.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, numbers = [], []
            for packed, found in zip(batch.column("z"), batch.column("spans")):
                raw = d.decompress(packed.as_py())
                whole = [(-(-x["start"] // CODE), x["stop"] // CODE) for x in found.as_py() or []]
                spans = _merge([(a, b) for a, b in whole if b - a >= words])
                starts = [m.start() for m in pattern.finditer(raw)] if spans else []
                n = len(starts) if spans else len(raw.split())
                kept, last = [], 0
                for a, b in spans:
                    kept.append(raw[last : starts[a]])
                    last = starts[b] if b < n else len(raw)
                text = b"".join([*kept, raw[last:]]).decode()
                texts.append(text)
                numbers.append((len(text), n, sum(b - a for a, b in spans), len(spans)))
            columns = [pa.array(x, pa.int64()) for x in (list(zip(*numbers)) or [()] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), *columns], names=[x.split()[0] for x in _CUT.split(", ")])

    return run


def remove_passages(docs: DataFrame, words: int = PASSAGE, hot: int = HOT) -> DataFrame:
    """Removes every word covered by a passage of `words` words that starts
    anywhere else too, in the same document or another, however long its words
    are and whatever stands between them; judged on the input, overlaps count,
    matches never cross documents. The white space behind a removed word goes
    with it.

    One row per input row: the columns of documents with the remaining text and
    its n_chars, then n_words of the input, n_removed words and n_spans. Words
    are known by 64-bit hashes. Null texts count as empty and become empty; texts
    of fewer words stay as they are; otherwise rows count as in dedup().
    """
    docs = documents(docs)
    rows = _keyed(docs)
    raw = rows.select("k", "k2", bytes_of().alias("raw")).filter(F.length("raw") >= 2 * words - 1).mapInArrow(_coded, f"{_ROW}, raw binary")
    spans = _spans_in(raw, words * CODE, hot, words * CODE).groupBy("k", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    packed = rows.select("k", "k2", "doc_id", "lang", "source", bytes_of().alias("raw")).mapInArrow(_squeeze, f"{_ROW}, doc_id long, lang string, source string, z binary")
    return packed.join(spans, ["k", "k2"], "left").select("doc_id", "lang", "source", "z", "spans").mapInArrow(_cut_words(words), _CUT)
