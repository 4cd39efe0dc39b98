"""Operator 7: a quality classifier by co-training.

Two classifiers see different views of a document: its text (words present,
shape of the writing) and its metadata (source, language, length). Over rounds
each goes over all unlabelled documents, and those of which it is surest train
the other. Both are calibrated on labelled documents that neither has trained
on, and their log odds are combined on others again. The same is done for
toxicity, which a document of good quality may have; clean documents pass both.

The views of all documents are made once, as a table of feature numbers; the
rounds and the final scoring read that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, crc_mod_col, discard, documents, materialize

DIM = 1 << 18
RESERVED = 256
#: Standard errors by which a feature's shares in the two classes must differ.
BEYOND_CHANCE = 4.0
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _hashed(x: bytes) -> int:
    return RESERVED + xxhash.xxh3_64_intdigest(x) % (DIM - RESERVED)


def text_view(text: str | None) -> np.ndarray:
    """Features that are present: distinct words, and bins of the writing's
    shape (shares of letters, capitals, digits, odd signs, repeated words and
    lines; word and line lengths)."""
    raw = (text or "").encode("utf-8", "replace")
    low = raw.lower()
    tokens = low.split()
    distinct = set(_WORD.findall(low))
    n, w = max(1, len(raw)), max(1, len(tokens))
    b = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(b, minlength=256)
    upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    spaces, high, odd = kinds[[32, 9, 10, 11, 12, 13]].sum(), kinds[128:].sum(), kinds[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 123, 124, 125, 126]].sum()
    lines = low.split(b"\n")
    stats = [upper / max(1, upper + lower), digits / n, odd / n, high / n, spaces / n, len(set(tokens)) / w, len(set(lines)) / max(1, len(lines)), min(1.0, n / w / 20), min(1.0, np.log1p(n / len(lines)) / 12), min(1.0, np.log1p(w) / 12), len(set(zip(tokens, tokens[1:]))) / w]
    shape = [i * 20 + min(19, int((v if i != 2 and i != 1 else min(1.0, 4 * v)) * 20)) for i, v in enumerate(stats)]
    return np.array(shape + [_hashed(x) for x in distinct], np.int64)


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = "none" if n_chars is None else str(int(np.log2(max(1, n_chars)) * 2))
    named = [f"source={source}", f"lang={lang}", f"size={size}", f"source={source} lang={lang}"]
    return np.unique(np.array([_hashed(x.encode()) for x in named], np.int64))


def train(views: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 10, l2: float = 5e-4) -> np.ndarray:
    """Logistic regression on present features by AdaGrad, in a fixed order,
    both classes weighing the same; the last weight is the bias."""
    w, g2 = np.zeros(DIM + 1), np.full(DIM + 1, 1e-2)
    # only features whose presence differs between the classes beyond chance
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    c1, c0 = (np.bincount(np.concatenate([*(v for v, label in zip(views, y) if label == side), np.zeros(0, np.int64)]), minlength=DIM) for side in (1, 0))
    p = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = np.abs(c1 / max(1, n1) - c0 / max(1, n0)) / np.sqrt(p * (1 - p) * (1 / max(1, n1) + 1 / max(1, n0)))
    telling = (z >= BEYOND_CHANCE) & (c1 + c0 >= 4)
    views = [np.append(v[telling[v]], DIM) for v in views]
    pos = weight[y == 1].sum() or 1.0
    neg = weight[y == 0].sum() or 1.0
    scale = np.where(y == 1, (pos + neg) / (2 * pos), (pos + neg) / (2 * neg)) * weight
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f = views[i]
            p = 1 / (1 + np.exp(-np.clip(w[f].sum(), -30, 30)))
            g = (p - y[i]) * scale[i] + l2 * w[f]
            g2[f] += g * g
            w[f] -= 0.3 * g / np.sqrt(g2[f])
    return w


def logit_of(w: np.ndarray, views: list[np.ndarray]) -> np.ndarray:
    return np.array([w[v].sum() + w[DIM] for v in views])


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's sigmoid over one or more scores: coefficients and a constant. The
    scores are taken in units of their spread, labels are smoothed as Platt
    does, and a ridge draws the slopes to 1, so that a small or separable set
    gives no certainty; Newton's method with halved steps."""
    z = np.atleast_2d(z)
    unit = np.maximum(np.sqrt((z * z).mean(axis=1)), 1e-6)
    x = np.column_stack([*(z / unit[:, None]), np.ones(len(y))])
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    want, ridge = np.append(np.ones(len(unit)), 0.0), np.append(np.ones(len(unit)), 1e-3)

    def loss(c: np.ndarray) -> float:
        m = x @ c
        return float((np.logaddexp(0, m) - t * m).sum() + (ridge * (c - want) ** 2).sum() / 2)

    c = want.copy()
    for _ in range(60):
        p = sigmoid(x @ c)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - t) + ridge * (c - want))
        size = 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c):
            size /= 2
        c = c - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return np.append(c[:-1] / unit, c[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logits(w: np.ndarray, packed: list[bytes]) -> np.ndarray:
    """logit_of() of many views as they are stored: never empty, 32-bit numbers."""
    if not packed:
        return np.zeros(0)
    ends = np.cumsum([len(x) // 4 for x in packed])
    return np.add.reduceat(w[np.frombuffer(b"".join(packed), np.int32)], np.append(0, ends[:-1])) + w[DIM]


@dataclass
class CoModel:
    text: np.ndarray
    meta: np.ndarray
    text_cal: np.ndarray
    meta_cal: np.ndarray
    both: np.ndarray

    def prob(self, t: list[bytes], m: list[bytes]) -> np.ndarray:
        a, b = logits(self.text, t), logits(self.meta, m)
        a, b = self.text_cal[0] * a + self.text_cal[1], self.meta_cal[0] * b + self.meta_cal[1]
        return sigmoid(self.both[0] * a + self.both[1] * b + self.both[2])


class CoTraining:
    """Two views of labelled rows, and what each has been given by the other. Of
    four rows three train and one calibrates while the rounds go on; at the end
    all train, and calibration goes by logits of models that haven't seen a row:
    the views' on one half of the rows, their combination's on the other."""

    def __init__(self, text: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray):
        self.own, self.y = {"text": text, "meta": meta}, y
        self.given: dict[str, dict[tuple, tuple[np.ndarray, int]]] = {"text": {}, "meta": {}}
        self.models: dict[str, np.ndarray] = {}
        self.cals: dict[str, np.ndarray] = {}

    def _both(self, on: np.ndarray) -> np.ndarray:
        """These rows if they have both labels, else all."""
        return on if len(set(self.y[on].tolist())) == 2 else np.arange(len(self.y))

    def _train(self, name: str, on: np.ndarray) -> np.ndarray:
        extra = [self.given[name][k] for k in sorted(self.given[name])]
        x = [self.own[name][i] for i in on] + [f for f, _ in extra]
        y = np.concatenate((self.y[on], np.array([side for _, side in extra], int)))
        return train(x, y, np.concatenate((np.ones(len(on)), np.full(len(extra), 0.5))))

    def learn(self) -> None:
        part = np.arange(len(self.y)) % 4
        for name, own in self.own.items():
            self.models[name] = self._train(name, self._both(np.flatnonzero(part != 3)))
            on = self._both(np.flatnonzero(part == 3))
            self.cals[name] = calibrate(logit_of(self.models[name], [own[i] for i in on]), self.y[on])

    def give(self, name: str, side: int, found: list[tuple], each: int) -> None:
        """The surest documents of view `name`, (key, text, meta) in order, to
        the other view; `each` of them that it hasn't got yet."""
        other = "meta" if name == "text" else "text"
        fresh = [x for x in found if x[0] not in self.given[other]][:each]
        self.given[other].update({key: (t if other == "text" else m, side) for key, t, m in fresh})

    def combined(self) -> CoModel:
        part = np.arange(len(self.y)) % 4
        one, other = (self._both(np.flatnonzero(part // 2 == h)) for h in (0, 1))
        z = {}
        for name, own in self.own.items():
            unseen = np.zeros(len(self.y))
            for fold in range(4):
                w = self._train(name, self._both(np.flatnonzero(part != fold)))
                on = np.flatnonzero(part == fold)
                unseen[on] = logit_of(w, [own[i] for i in on])
            self.models[name] = self._train(name, np.arange(len(self.y)))
            self.cals[name] = calibrate(unseen[one], self.y[one])
            z[name] = self.cals[name][0] * unseen[other] + self.cals[name][1]
        return CoModel(self.models["text"], self.models["meta"], self.cals["text"], self.cals["meta"], calibrate(np.array([z["text"], z["meta"]]), self.y[other]))


_VIEWS = "doc_id long, held_out boolean, u long, t binary, m binary"


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = [text_view(x.as_py()).astype(np.int32).tobytes() for x in batch.column("text")]
        m = [meta_view(*x).astype(np.int32).tobytes() for x in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("u"), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "held_out", "u", "t", "m"])


def views_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, u (a hash of the whole row), t and m (its views) of every
    row of documents."""
    u = F.xxhash64(*[F.col(c) for c in docs.columns]).alias("u")
    return docs.select("doc_id", (crc_mod_col(10) == 0).alias("held_out"), u, "text", "source", "lang", "n_chars").mapInArrow(_views, _VIEWS)


def _surest(asks, sure: float, most: int):
    """Of each batch and each (number, view): the rows that the view is surest
    of, on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = {"text": batch.column("t").to_pylist(), "meta": batch.column("m").to_pylist()}
            for number, (name, w, cal) in asks.value.items():
                p = sigmoid(cal[0] * logits(w, packed[name]) + cal[1])
                for side, x in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero(x >= sure)
                    at = at[np.argsort(-x[at], kind="stable")[:most]] if len(at) > most else at
                    own = batch.select(["doc_id", "u"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int32)), pa.array(np.full(len(at), side, np.int32)), *own.columns, pa.array(x[at])], names=["number", "side", "doc_id", "u", "p"])

    return run


def _bounded(views: DataFrame, chosen: DataFrame) -> list:
    """The rows of views that `chosen` names by doc_id and u, a bounded number, each
    once however often it is repeated; with the columns of chosen."""
    return views.select("doc_id", "u", "t", "m").join(F.broadcast(chosen), ["doc_id", "u"]).dropDuplicates(chosen.columns).collect()


def _array(x) -> np.ndarray:
    return np.frombuffer(bytes(x), np.int32).astype(np.int64)


def fit(views: DataFrame, labels: DataFrame, most: int = 6000, rounds: int = 3, each: int = 200, sure: float = 0.95) -> tuple[CoModel | None, CoModel | None]:
    """Models of quality and toxicity, None where there are not both labels.

    `most` bounds the labelled rows that are fit on (those with the smallest
    hashes, of ids whose crc32 mod 10 is not 0). In each round each view goes
    over all documents without a label and gives the other view the `each`
    surest of either side that it hasn't got yet, if it is `sure` of them."""
    spark = views.sparkSession
    marks = labels.select(column(labels, "doc_id", "bigint"), column(labels, "quality", "int"), column(labels, "toxic", "int")).filter("doc_id is not null and (quality is not null or toxic is not null)")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    usable = views.filter("not held_out and doc_id is not null")
    order = F.pmod(F.xxhash64("doc_id", F.lit("quality-sample")), F.lit(1 << 40))
    chosen = usable.select("doc_id", "u").distinct().join(marks, "doc_id").withColumn("o", order).orderBy("o", "doc_id", "u").limit(most)
    own = sorted(_bounded(views, materialize(chosen, "op7-labelled")), key=lambda r: (r.o, r.doc_id, r.u))
    both = []
    for name in ("quality", "toxic"):
        rows = [r for r in own if r[name] is not None]
        y = np.array([int(r[name] > 0) for r in rows], int)
        both.append(CoTraining([_array(r.t) for r in rows], [_array(r.m) for r in rows], y) if len(set(y.tolist())) == 2 else None)
    for _ in range(rounds if any(both) else 0):
        asks = {}
        for i, c in enumerate(both):
            if c:
                c.learn()
                asks |= {2 * i + j: (name, c.models[name], c.cals[name]) for j, name in enumerate(("text", "meta"))}
        limit = each * (rounds + 1)
        found = usable.select("doc_id", "u", "t", "m").mapInArrow(_surest(spark.sparkContext.broadcast(asks), sure, limit), "number int, side int, doc_id long, u long, p double")
        found = found.join(marks.select("doc_id"), "doc_id", "left_anti").distinct()
        best = Window.partitionBy("number", "side").orderBy(F.desc("p"), "u", "doc_id")
        top = materialize(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= limit), "op7-surest")
        got = sorted(_bounded(views, top), key=lambda r: (r.number, r.side, r.r))
        discard(top)
        for number, (name, _, _) in asks.items():
            for side in (1, 0):
                both[number // 2].give(name, side, [((r.doc_id, r.u), _array(r.t), _array(r.m)) for r in got if (r.number, r.side) == (number, side)], each)
    out = []
    for c in both:
        out.append(c.combined() if c else None)
    return out[0], out[1]


def _score(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, toxic = models.value
        for batch in batches:
            t, m = batch.column("t").to_pylist(), batch.column("m").to_pylist()
            q = good.prob(t, m) if good else np.full(len(t), 0.5)
            x = toxic.prob(t, m) if toxic else np.zeros(len(t))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(q), pa.array(x), pa.array(q * (1 - x)), pa.array((q >= 0.5) & (x < 0.5))], names=["doc_id", "held_out", "quality", "toxic", "score", "keep"])

    return run


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, held_out (crc32(doc_id as text) mod 10 is 0,
    never trained on), quality and toxic (calibrated probabilities), score
    (quality * (1 - toxic)), keep (quality at least 0.5, toxic under 0.5).

    Null texts are empty, null metadata are values of their own; labels of one
    document that differ count as bad and toxic; labels of unknown documents
    are ignored; without both labels quality is 0.5 and toxic 0; whole texts
    are read; rows that repeat an id are scored each, equal ones are learned
    from once; ties of sureness go by a hash of the row; null ids are kept; extra
    columns are ignored; an empty table gives an empty result.
    """
    views = materialize(views_of(documents(docs)), "op7-views")
    models = docs.sparkSession.sparkContext.broadcast(fit(views, labels, **options))
    return views.select("doc_id", "held_out", "t", "m").mapInArrow(_score(models), "doc_id long, held_out boolean, quality double, toxic double, score double, keep boolean")
