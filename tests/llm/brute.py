"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def suffix_dedup(rows, length):
    """rows: (doc_id, text), in order; a list of results in that order."""
    starts = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for b in raws:
        for i in range(len(b) - length + 1):
            starts[b[i : i + length]] += 1
    out = []
    for (d, _), b in zip(rows, raws):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats(rows, least):
    """(id, bytes covered by strings of `least` bytes that start elsewhere too, those of the longest run)."""
    starts = Counter(b[i : i + least] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - least + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        on = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if starts[b[i : i + least]] > 1:
                on[i : i + least] = b"\1" * least
        out.append((d, sum(on), max(map(len, bytes(on).split(b"\0")), default=0)))
    return out


def passages(rows, words):
    """(id, remaining text, words, words removed) for passages of `words` words that start elsewhere too."""
    split = [(d, re.findall(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", b := (t or "").encode()), b) for d, t in rows]
    starts = Counter(tuple(x.split()[0] for x in w[i : i + words]) for _, w, _ in split for i in range(len(w) - words + 1))
    out = []
    for d, w, b in split:
        gone = [False] * len(w)
        for i in range(len(w) - words + 1):
            if starts[tuple(x.split()[0] for x in w[i : i + words])] > 1:
                gone[i : i + words] = [True] * words
        front = b[: len(b) - len(b.lstrip())]
        out.append((d, (front + b"".join(x for x, y in zip(w, gone) if not y)).decode(), len(w), sum(gone)))
    return out


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(rows, n, num, den):
    sets = [(d, shingles(t, n)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[find(i)].append(d)
    return [(d, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, s) in enumerate(sets)]


def segmentations(text, pieces):
    """Probability of a byte string over all its segmentations."""
    if not text:
        return 1.0
    return sum(p * segmentations(text[len(x) :], pieces) for x, p in pieces.items() if text.startswith(x))


def lm_base(rows):
    train, texts = Counter(), 0
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            train.update((t or "").encode().lower().split())
            texts += 1
    n, v = sum(train.values()) + texts, len(train) + (texts > 0)
    low = math.log10(n + 0.1 * (v + 1))
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        base = sum(math.log10(train[x] + 0.1) - low for x in w) + math.log10(texts + 0.1) - low
        out[d] = (zlib.crc32(str(d).encode()) % 10 == 0, len(w) + 1, sum(train[x] > 0 for x in w) + (texts > 0), n, base)
    return out


def licence_base(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    at, labels = [], set()
    for phrase, name in ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(name)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def edited(rows):
    """(doc_id, text) in the operator's order is up to the caller."""
    out = []
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        out.append((d, t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]))
    return out


def lattice_paths(text, pieces, log=False):
    """Probability of a byte string over its segmentations, and the expected
    number of times that each piece is used, by plain sums over places."""
    n, most = len(text), max(map(len, pieces))
    ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    arcs = [(i, j, pieces[text[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + most) + 1) if text[i:j] in pieces]
    for i, j, p in arcs:
        ahead[j] += ahead[i] * p
    for i, j, p in reversed(arcs):
        back[i] += p * back[j]
    used = Counter()
    for i, j, p in arcs:
        used[text[i:j]] += ahead[i] * p * back[j] / ahead[n]
    return ahead[n], used


def lm_scores(rows, start, end):
    """(score, lattice score) of each document by plain loops: one expectation
    step over the training words from the probabilities `start`, then the lattice
    and the learned words. end: the end's piece."""
    train, texts = Counter(), 0
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            train.update((t or "").encode().lower().split())
            texts += 1
    used = Counter({end: float(texts)})
    for w, c in train.items():
        for x, k in lattice_paths(b" " + w, start)[1].items():
            used[x] += c * k
    total = sum(used.values())
    prior = min(10_000.0, max(total, 1.0))
    p = {x: (used[x] + prior * q) / (total + prior) for x, q in start.items()}
    n, v = sum(train.values()) + texts, max(1, len(train) + (texts > 0))
    mixed = lambda c, q: math.log10((c + v * q) / (n + v))
    out = {}
    for d, t in rows:
        q = [(train[w], lattice_paths(b" " + w, p)[0]) for w in (t or "").encode().lower().split()]
        out[d] = (sum(mixed(c, x) for c, x in q) + mixed(texts, p[end]), sum(math.log10(x) for _, x in q) + math.log10(p[end]))
    return out


def licence_labels(text, notices, label, expression):
    """Labels by notices that stand in the words, and of the expression behind
    each tag, which are found by a plain search."""
    low = (text or "").encode().lower()
    words = " " + " ".join(w.decode("utf-8", "replace") for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    out = {name for phrase, name in notices.items() if f" {phrase} " in words}
    flat = low.decode("utf-8", "replace")
    for m in re.finditer(r"(?:spdx-license-identifier|license-expression|licen[cs]e):(?=([^\n]*))", flat):
        found = expression(m[1])
        out |= {x for i in (found[0] if found else ()) if (x := label(i))}
    return ",".join(sorted(out))
