"""Operator 5: likelihood of a text over a lattice of subwords.

The pieces of an existing public vocabulary span a lattice over each word; its
paths are all the segmentations. A forward recursion in log space sums them, so
a word's probability is marginal over its segmentations, and a text's is the
product of its words' and of one end. The vocabulary's scores are ranks, so
they start as -log rank and are set to the corpus once: expected counts of the
pieces (forward-backward over all training words, weighted by their counts). A
whole word that was learned is one more arc over its part of the lattice.

A word's score doesn't depend on the text it stands in. Words are counted over
the corpus, scored once each, and joined back: the head of the distribution (at
most HEAD words) by broadcast within the scan of the texts, the tail by a
shuffled join on the word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, column, crc_mod_col, discard, materialize, words

HEAD = 100_000
#: Words longer than this in bytes are worked on in blocks, and never broadcast.
LONG = 2048
SHORT = 64
END = b"</text>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Pieces by their bytes with natural log probabilities; any byte is a
    piece. Words of one length are worked on together: a piece is found by a
    rolling hash of its bytes, the recursions run over places of the words."""

    def __init__(self, score: dict[bytes, float]):
        self.pieces = sorted(score)
        self.score = score
        self.most = max(map(len, self.pieces))
        self.values = np.array([score[p] for p in self.pieces])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in self.pieces}):
            own = [(i, p) for i, p in enumerate(self.pieces) if len(p) == n]
            h = np.zeros(len(own), np.uint64)
            m = np.frombuffer(b"".join(p for _, p in own), np.uint8).reshape(len(own), n)
            for k in range(n):
                h = h * _BASE + m[:, k] + np.uint64(1)
            order = np.argsort(h)
            likely = np.zeros(1 << 16, bool)
            likely[h >> np.uint64(48)] = True
            self.by_length[n] = h[order], np.array([i for i, _ in own])[order], likely

    @classmethod
    def of_file(cls, path: str | None) -> "Lattice":
        """Of a sentencepiece file. Its scores are ranks of merges: a piece of
        rank r gets a weight of 1/(r + 100), as in Zipf's and Mandelbrot's law."""
        import public_tokenizers as P
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path or P.path("piece_bpe_32k.model"))
        raw: dict[bytes, float] = {}
        for i in range(m.get_piece_size()):
            if m.is_control(i) or m.is_unknown(i):
                continue
            if m.is_byte(i):
                b = bytes([int(m.id_to_piece(i)[3:5], 16)])
            else:
                b = m.id_to_piece(i).replace("\u2581", " ").encode().lower()
            raw[b] = raw.get(b, 0.0) + 1.0 / (101.0 + max(0.0, -m.get_score(i)))
        for i in range(256):
            raw.setdefault(bytes([i]), 1.0 / 50_000)
        raw[END] = max(raw.values())
        total = sum(raw.values())
        return cls({b: math.log(v / total) for b, v in raw.items()})

    def _find(self, m: np.ndarray) -> np.ndarray:
        """Of words of one length (a row of bytes each): the index of the piece
        of k + 1 bytes at each place, or -1."""
        rows, n = m.shape
        out = np.full((rows, min(self.most, n), n), -1, np.int64)
        h = np.zeros((rows, n), np.uint64)
        for k in range(out.shape[1]):
            h = h[:, : n - k] * _BASE + m[:, k:] + np.uint64(1)
            if k + 1 not in self.by_length:
                continue
            known, index, likely = self.by_length[k + 1]
            r, c = np.nonzero(likely[h >> np.uint64(48)])
            x = h[r, c]
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            hit = known[at] == x
            out[r[hit], k, c[hit]] = index[at[hit]]
        return out

    def _forward(self, s: np.ndarray) -> np.ndarray:
        rows, most, n = s.shape
        f = np.zeros((rows, n + 1))
        for j in range(1, n + 1):
            k = np.arange(min(most, j))
            x = f[:, j - 1 - k] + s[:, k, j - 1 - k]
            top = x.max(axis=1)
            f[:, j] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        return f

    def _backward(self, s: np.ndarray) -> np.ndarray:
        rows, most, n = s.shape
        b = np.zeros((rows, n + 1))
        for i in range(n - 1, -1, -1):
            k = np.arange(min(most, n - i))
            x = b[:, i + 1 + k] + s[:, k, i]
            top = x.max(axis=1)
            b[:, i] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        return b

    def _groups(self, words_: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in the list, pieces and scores of words of one length, a space
        ahead of each; so many at once that the arrays stay small."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words_):
            if len(w) <= LONG:
                by.setdefault(len(w), []).append(i)
        for n, at in sorted(by.items()):
            step = max(1, 400_000 // ((n + 1) * min(self.most, n + 1)))
            for a in range(0, len(at), step):
                own = at[a : a + step]
                m = np.frombuffer(b"".join(b" " + words_[i] for i in own), np.uint8).reshape(len(own), n + 1).astype(np.uint64)
                piece = self._find(m)
                yield np.array(own), piece, np.where(piece >= 0, self.values[piece], -np.inf)

    def _blocks(self, word: bytes, back: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """A long word, a space ahead, in blocks of starts a..b: the pieces and
        scores of each. Memory is that of a block, whatever the word's length."""
        text = np.frombuffer(b" " + word, np.uint8)
        starts = range(0, len(text), LONG)
        for a in reversed(starts) if back else starts:
            b = min(a + LONG, len(text))
            piece = self._find(text[None, a : b + self.most].astype(np.uint64))[0, :, : b - a]
            yield a, b, piece, np.where(piece >= 0, self.values[piece], -np.inf)

    def _long_forward(self, word: bytes) -> np.ndarray:
        f = np.full(len(word) + 2, -np.inf)
        f[0] = 0.0
        for a, b, _, s in self._blocks(word):
            for i in range(a, b):
                to = f[i + 1 : i + 1 + len(s)]
                np.logaddexp(to, f[i] + s[: len(to), i - a], out=to)
        return f

    def _long_expected(self, word: bytes, count: float, out: np.ndarray) -> None:
        f = self._long_forward(word)
        back = np.full(len(f), -np.inf)
        back[-1] = 0.0
        for a, b, piece, s in self._blocks(word, back=True):
            for i in range(b - 1, a - 1, -1):
                to = back[i + 1 : i + 1 + len(s)]
                back[i] = np.logaddexp.reduce(to + s[: len(to), i - a])
            k, i = np.nonzero(piece >= 0)
            p = np.exp(f[a + i] + s[k, i] + back[a + i + k + 1] - f[-1]) * count
            out += np.bincount(piece[k, i], weights=p, minlength=len(out))

    def log_probabilities(self, words_: list[bytes]) -> np.ndarray:
        """Marginal log10 probability of each word over its segmentations."""
        out = np.zeros(len(words_))
        for own, _, s in self._groups(words_):
            out[own] = self._forward(s)[:, -1] / math.log(10)
        for i, w in enumerate(words_):
            if len(w) > LONG:
                out[i] = self._long_forward(w)[-1] / math.log(10)
        return out

    def expected(self, words_: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of times that each piece is used."""
        out = np.zeros(len(self.pieces))
        for own, piece, s in self._groups(words_):
            f, b = self._forward(s), self._backward(s)
            r, k, i = np.nonzero(piece >= 0)
            p = np.exp(f[r, i] + s[r, k, i] + b[r, i + k + 1] - f[r, -1]) * counts[own][r]
            out += np.bincount(piece[r, k, i], weights=p, minlength=len(out))
        for w, c in zip(words_, counts):
            if len(w) > LONG:
                self._long_expected(w, float(c), out)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a batch of texts with their counts in all texts and in those
    that are learned from."""
    for batch in batches:
        train, other = Counter(), Counter()
        for held, raw in zip(batch.column("held_out").to_pylist(), batch.column("raw")):
            (other if held else train).update(words(raw.as_py()))
        both = list(train.keys() | other.keys())
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array([train[w] for w in both], pa.int64()), pa.array([train[w] + other[w] for w in both], pa.int64())], names=["word", "c", "total"])


def _expect(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.pieces))
        for batch in batches:
            total += lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lattice.pieces[i] for i in used], pa.binary()), pa.array(total[used])], names=["piece", "x"])

    return run


def mixture(c: np.ndarray, lattice: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 of (c + v * 10^lattice) / (n + v): the whole word is one more arc
    of the lattice, its weight as of Witten and Bell."""
    with np.errstate(divide="ignore"):
        own = np.log10(c.astype(np.float64))
    back = math.log10(max(v, 1)) + lattice
    top = np.maximum(own, back)
    return top + np.log10(10.0 ** (own - top) + 10.0 ** (back - top)) - math.log10(n + max(v, 1))


def _word_scores(lattice: Lattice, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lattice.log_probabilities(batch.column("word").to_pylist())
            s = mixture(batch.column("c").to_numpy(), x, n, v)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("total"), pa.array(s), pa.array(x)], names=["word", "c", "total", "score", "pieces"])

    return run


def _texts(head, n: int, v: int):
    """Sums over the words of the head; the other words as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, float, float]] = head.value
        low = math.log10(n + 0.1 * (v + 1)) if n or v else math.log10(0.1)
        for batch in batches:
            rows = []
            for raw in batch.column("raw"):
                base = lattice = pieces = 0.0
                hits, tail = 0, []
                count = Counter(words(raw.as_py()))
                for w in sorted(count):
                    k, x = count[w], known.get(w)
                    if x is None:
                        tail.append({"w": w, "k": k})
                        continue
                    base += k * (math.log10(x[0] + 0.1) - low)
                    lattice += k * x[1]
                    pieces += k * x[2]
                    hits += k * (x[0] > 0)
                rows.append((sum(count.values()), hits, base, lattice, pieces, tail))
            c = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("w", pa.binary()), ("k", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("held_out"), *(pa.array(x, t) for x, t in zip(c, kinds))], names=["uid", "doc_id", "held_out", "tokens", "known", "base", "lattice", "pieces", "tail"])

    return run


def score(docs: DataFrame, vocabulary: str | None = None, head: int = HEAD) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 of the marginal probability, learned words being
    arcs of the lattice too), lattice_score (the same without them: the
    vocabulary's pieces alone).

    Counts are over all documents whose crc32(doc_id as text) mod 10 is not 0;
    all are scored. Null and empty texts are one end; very long words are
    lattices like any other, worked on in blocks; rows that repeat an id count and are scored each;
    a null id counts as empty text in the crc; extra columns are ignored; an
    empty table gives an empty result. vocabulary: a sentencepiece file; head:
    most words that are broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string"))
    rows = rows.select("doc_id", (crc_mod_col(10) == 0).alias("held_out"), bytes_of().alias("raw"))
    # the words of all documents, counted where they are read, then by word
    counted = rows.select("held_out", "raw").mapInArrow(_count, "word binary, c long, total long")
    table = materialize(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total")), "op5-words")
    texts = rows.agg(F.count_if(~F.col("held_out")).alias("t")).first().t or 0
    sums = table.filter("c > 0").agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n, v = (sums.n or 0) + texts, (sums.v or 0) + (texts > 0)
    # the pieces' probabilities; a row per piece of the vocabulary comes here
    start = Lattice.of_file(vocabulary)
    found = table.filter("c > 0").select("word", "c").mapInArrow(_expect(start), "piece binary, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
    x = {bytes(r.piece): r.x for r in found}
    x[END] = float(texts)
    total = sum(x.values())
    prior = min(10_000.0, max(total, 1.0))
    lattice = Lattice({b: math.log((x.get(b, 0.0) + prior * math.exp(s)) / (total + prior)) for b, s in start.score.items()})
    end_pieces = lattice.score[END] / math.log(10)
    end = float(mixture(np.array([texts]), np.array([end_pieces]), n, v)[0])
    scored = materialize(table.mapInArrow(_word_scores(lattice, n, v), "word binary, c long, total long, score double, pieces double"), "op5-scores")
    discard(table)
    # the head is bounded in words and in bytes; written first, so that it alone comes to the driver
    top = materialize(scored.filter(F.length("word") <= SHORT).orderBy(F.desc("total"), "word").limit(head), "op5-head")
    known = spark.sparkContext.broadcast({bytes(r.word): (r.c, r.score, r.pieces) for r in top.collect()})
    discard(top)
    parts = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "raw").mapInArrow(_texts(known, n, v), "uid long, doc_id long, held_out boolean, tokens long, known long, base double, lattice double, pieces double, tail array<struct<w: binary, k: long>>")
    parts = materialize(parts, "op5-texts")
    low = math.log10(n + 0.1 * (v + 1))
    tail = parts.select("uid", F.explode("tail").alias("t")).select("uid", F.col("t.w").alias("word"), F.col("t.k").alias("k")).join(scored, "word")
    sums = [F.sum(F.col("k") * (F.log10(F.col("c") + 0.1) - low)).alias("b"), F.sum(F.col("k") * F.col("score")).alias("l"), F.sum(F.col("k") * F.col("pieces")).alias("p"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("h")]
    out = parts.drop("tail").join(tail.groupBy("uid").agg(*sums), "uid", "left")
    end_base = math.log10(texts + 0.1) - low
    or0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "doc_id", "held_out", (F.col("tokens") + 1).alias("n_tokens"), (F.col("known") + or0("h") + (1 if texts else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + or0("b") + end_base).alias("base_score"), (F.col("lattice") + or0("l") + end).alias("score"), (F.col("pieces") + or0("p") + end_pieces).alias("lattice_score"),
    )
