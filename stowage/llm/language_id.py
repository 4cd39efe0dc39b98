"""Operator 10: hierarchical language identification. A linear model first
tells the language family, then one-versus-one linear support vector machines
tell the languages of that family apart. Families are learned too: languages
whose letter profiles are close are one family.

Features are hashed byte n-grams (1 to 4, words padded with a space) of the
whole text, letters lower-cased, anything but letters as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, column, crc_mod_col

DIM = 1 << 13
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(raw: bytes) -> bytes:
    """Letters in lower case, everything between them one space."""
    return (" " + _OTHER.sub(" ", raw.decode("utf-8", "replace")).strip() + " ").lower().encode()


def features(raw: bytes) -> np.ndarray | None:
    """Square roots of n-gram shares, of length 1; None without letters."""
    text = letters(raw)
    if not text.strip():
        return None
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = np.bincount((b * np.uint32(2654435761)) >> np.uint32(19), minlength=DIM).astype(np.float32)
    h = b
    for _ in range(3):
        h = h[:-1] * np.uint32(0x01000193) ^ b[-len(h) + 1 :] if len(h) > 1 else h[:0]
        out += np.bincount((h * np.uint32(2654435761)) >> np.uint32(19), minlength=DIM)
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, c: float = 20.0) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with
    squared hinge loss, classes weighing the same; y is -1 or 1. Dual
    coordinate descent (Hsieh et al. 2008), in a fixed order."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diag = 1.0 / (2 * c * weight)
    q = 2.0 + diag  # every row has length 1, and a one for the bias
    w, bias, alpha = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7).permutation(len(y))
    for _ in range(rounds):
        moved = 0.0
        for i in order:
            g = y[i] * (float(x[i] @ w) + bias) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


@dataclass
class Model:
    families: list[list[str]]
    family_weights: np.ndarray
    pairs: list[dict[tuple[int, int], np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        one = np.append(x, 1.0)
        s = self.family_weights @ one
        f = int(s.argmax())
        e = np.exp(4 * (s - s.max()))
        sure = float(e[f] / e.sum())
        langs = self.families[f]
        votes, margin = np.zeros(len(langs)), np.zeros(len(langs))
        for (a, b), w in self.pairs[f].items():
            m = float(w @ one)
            votes[a if m > 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        best = max(range(len(langs)), key=lambda i: (votes[i], margin[i]))
        if len(langs) > 1:
            sure *= float(1 / (1 + np.exp(-4 * margin[best] / (len(langs) - 1))))
        return langs[best], sure


def families_of(profiles: np.ndarray, link: float | None = None) -> list[list[int]]:
    """Average-linkage clusters of profiles: the closest are joined until about
    the square root of their number is left, none of more than twice that and
    two. So languages that are close stand in one family however far the families
    are apart. With `link`, they are joined while their cosine is over it instead,
    with at least two families left if there are two languages."""
    n = len(profiles)
    left, largest = (max(1, round(n**0.5)), 2 * round(n**0.5) + 2) if link is None else (2, n)
    groups = [[i] for i in range(n)]
    sums, sizes = (profiles @ profiles.T).astype(np.float64), np.ones(n)
    while len(groups) > left:
        free = np.tri(len(groups), k=-1, dtype=bool) & (sizes[:, None] + sizes <= largest)
        means = np.where(free, sums / np.outer(sizes, sizes), -np.inf)
        a, b = divmod(int(means.argmax()), len(groups))
        if means[a, b] == -np.inf or (link is not None and means[a, b] < link):
            break
        groups[b] += groups.pop(a)
        sums[b] += sums[a]
        sums[:, b] += sums[:, a]
        sizes[b] += sizes[a]
        sums, sizes = np.delete(np.delete(sums, a, 0), a, 1), np.delete(sizes, a)
    return groups


def fit(rows: list[tuple[bytes, str]], link: float | None = None) -> Model:
    """rows: (text, language)."""
    return fit_features([(x, lang) for raw, lang in rows if (x := features(raw)) is not None], link)


def fit_features(seen: list[tuple[np.ndarray, str]], link: float | None = None) -> Model:
    """seen: (features, language)."""
    langs = sorted({lang for _, lang in seen})
    if not langs:
        return Model([["und"]], np.zeros((1, DIM + 1)), [{}])
    x = np.array([v for v, _ in seen], np.float32)
    y = np.array([langs.index(lang) for _, lang in seen])
    profiles = np.array([x[y == i].mean(axis=0) for i in range(len(langs))])
    profiles -= profiles.mean(axis=0)
    profiles /= np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    groups = [sorted(g) for g in families_of(profiles, link)] if len(langs) > 1 else [[0]]
    weights, pairs = [], []
    for g in groups:
        mine = np.isin(y, g)
        weights.append(train_svm(x, np.where(mine, 1.0, -1.0)) if len(groups) > 1 else np.zeros(DIM + 1))
        pairs.append({(a, b): train_svm(x[sel], np.where(y[sel] == g[a], 1.0, -1.0)) for b in range(len(g)) for a in range(b) if (sel := np.isin(y, [g[a], g[b]])).any()})
    return Model([[langs[i] for i in g] for g in groups], np.array(weights), pairs)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of whole texts, those that aren't 0; texts without letters
    have none and go."""
    for batch in batches:
        found = [(i, x) for i, raw in enumerate(batch.column("raw")) if (x := features(raw.as_py())) is not None]
        own = batch.select(["lang", "u", "key"]).take(pa.array([i for i, _ in found], pa.int64()))
        at = [np.flatnonzero(x) for _, x in found]
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([x[a].tobytes() for a, (_, x) in zip(at, found)], pa.binary())], names=["lang", "u", "key", "at", "x"])


def sample_of(docs: DataFrame, per_lang: int, rows: int) -> list[tuple[np.ndarray, str]]:
    """Bounded training rows (features, language): of the documents whose
    remainder isn't 2 with a language, the texts with the smallest hashes, per_lang
    of each language, fewer (4 at least) where there are so many languages that
    it would be over `rows`. Every language is learned; texts are read whole, on
    the executors."""
    labelled = docs.filter((crc_mod_col(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("c"))
    per_lang = min(per_lang, max(4, rows // max(1, counts.count())))
    h = (F.pmod(F.xxhash64(F.col("text"), F.lit("lang-sample")), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    want = counts.select("lang", F.least(F.lit(1.0), F.lit(1.2 * per_lang + 30.0) / F.col("c")).alias("want"))
    raw = F.col("text").cast("binary")
    picked = labelled.select("lang", h, raw.alias("raw"), F.md5(raw).alias("key")).join(F.broadcast(want), "lang").filter("u < want")
    picked = picked.dropDuplicates(["lang", "u", "key"])  # however often a text stands there, it is one
    first = picked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "key"))).filter(F.col("r") <= per_lang)
    out = []
    for r in sorted(first.select("lang", "u", "key", "raw").mapInArrow(_features, "lang string, u double, key string, at binary, x binary").collect(), key=lambda r: (r.lang, r.u, r.key)):
        x = np.zeros(DIM, np.float32)
        x[np.frombuffer(bytes(r.at), np.uint16)] = np.frombuffer(bytes(r.x), np.float32)
        out.append((x, r.lang))
    return out


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for raw in batch.column("raw"):
                x = features(raw.as_py())
                lang, s = ("und", 0.0) if x is None else model.predict(x)
                langs.append(lang)
                scores.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, per_lang: int = 400, rows: int = 8000) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score (0 to 1).

    The model is fit on at most per_lang documents of each language, about `rows`
    in all (see sample_of); only text is read for a prediction. Null texts
    and texts without letters are `und` with score 0; null languages are not
    learned from; without any labelled text all is `und`; very long texts are
    read whole; rows that repeat an id are predicted each; null ids are kept;
    extra columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string"), column(docs, "lang", "string"))
    model = fit_features(sample_of(own, per_lang, rows))
    raw = own.select("doc_id", (crc_mod_col(4) == 2).alias("held_out"), bytes_of().alias("raw"))
    return raw.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def accept(docs: DataFrame, **options) -> DataFrame:
    """Documents with a language, as they are; those that are `und` go. With
    nothing to learn from, only those without letters do."""
    from .common import documents

    docs = documents(docs)
    sample = sample_of(docs, options.get("per_lang", 400), options.get("rows", 8000))
    model, learned = fit_features(sample), bool(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(x := features((t.as_py() or "").encode("utf-8", "surrogatepass"))) is not None and (not learned or model.predict(x)[0] != "und") for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
