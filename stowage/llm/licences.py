"""Operator 8: licence scan. Aho-Corasick automata find identifier tags and
notice phrases in one pass over a text; a shunting-yard parser turns the
expression behind a tag (and/or/with, parentheses) into postfix and evaluates
it to the set of licences and whether each is required or an alternative. An
expression of more alternatives than are told apart is kept as it is written,
with all its licences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bytes_of, column

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases of the method, as words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "the software is provided as is without warranty of any kind": "mit",
    "licensed under the apache": "apache",
    "apache software foundation license": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "eclipse distribution license": "bsd",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "european union public licence": "eupl",
    "creative commons": "cc",
    "cc0 1 0 universal": "cc0",
    "open database license": "odbl",
    "open data commons": "odc",
    "open software license": "osl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "microsoft public license": "ms",
    "python software foundation license": "psf",
    "postgresql license": "postgresql",
    "sil open font license": "ofl",
    "universal permissive license": "upl",
    "university of illinois ncsa open source license": "ncsa",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "zlib license": "zlib",
    "zope public license": "zpl",
    "server side public license": "sspl",
    "business source license": "busl",
    "all rights reserved": "proprietary",
}
#: Tags, and identifiers that have no version behind them.
TAGS = ("spdx-license-identifier", "license-expression", "licence", "license")
FAMILIES = ("mit", "apache", "lgpl", "agpl", "gpl", "bsd", "mpl", "epl", "cc0", "cc", "isc", "unlicense", "zlib", "proprietary")
PLAIN = ("0bsd", "afl", "artistic", "beerware", "cddl", "curl", "eupl", "ftl", "hpnd", "icu", "ijg", "imagemagick", "json", "libpng", "libtiff", "ncsa", "netcdf", "ofl", "openssl", "postgresql", "psf", "python", "ruby", "sleepycat", "sspl", "upl", "vim", "w3c", "wtfpl", "x11", "xnet", "zpl")
#: A name with a version, as listed identifiers have it: its label is the name.
VERSIONED = re.compile(r"([a-z][a-z0-9]*(?:-[a-z]+)*?)-v?[0-9]+(?:\.[0-9]+)+(?:-(?:only|or-later|[a-z]{2,3}))?\+?$")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9][a-z0-9.+\-]*)")
RANK = {"or": 1, "and": 2, "with": 3}


def postfix(tokens: list[str]) -> list[str] | None:
    """Dijkstra's shunting yard; None if the expression isn't well formed."""
    out, stack, operand = [], [], True
    for t in tokens:
        if t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(post: list[str]) -> list[frozenset[str]] | None:
    """The alternatives of an expression, each a set of licences to be kept
    together; an exception behind `with` stays with its licence. None if there
    are over 64, which can be as many as two to the power of the licences."""
    stack: list[list[frozenset[str]]] = []
    for t in post:
        if t not in RANK:
            stack.append([frozenset([t])])
            continue
        b, a = stack.pop(), stack.pop()
        if t == "or":
            made = list(dict.fromkeys(a + b))
        elif t == "and":
            made = list(dict.fromkeys(x | y for x in a for y in b))
        else:
            made = [frozenset(f"{i} with {'+'.join(sorted(y))}" for i in x) for x in a for y in b]
        if len(made) > 64:
            return None
        stack.append(made)
    return stack[0]


def licences_of(post: list[str]) -> list[str]:
    """The licences of an expression in their order, without what stands behind
    `with`."""
    out, starts = [], []
    for t in post:
        if t not in RANK:
            starts.append(len(out))
            out.append(t)
            continue
        b = starts.pop()
        if t == "with":
            del out[b:]
    return out


def expression(text: str, at: int = 0, stop: int | None = None) -> tuple[set[str], str] | None:
    """Licences of the longest well-formed expression of text[at:stop] at its
    start, and the expression: its alternatives, or as it is written."""
    tokens, stop = [], len(text) if stop is None else stop
    # a word after a complete operand ends the expression
    operand, depth, good = True, 0, 0
    while m := TOKEN.match(text, at, stop):
        at = m.end()
        t = m[1].rstrip(".") or m[1]
        if t == "(" and operand:
            depth += 1
        elif t == ")" and not operand and depth:
            depth -= 1
        elif t in RANK and not operand:
            operand = True
        elif t not in RANK and t not in "()" and operand:
            operand = False
        else:
            break
        tokens.append(t)
        if not operand and not depth:
            good = len(tokens)
    post = postfix(tokens[:good]) if good else None
    if not post:
        return None
    alternatives = evaluate(post)
    if alternatives is None:
        return set(licences_of(post)), " ".join(tokens[:good]).replace("( ", "(").replace(" )", ")")
    return {i for a in alternatives for i in a}, " or ".join(" and ".join(sorted(a)) for a in alternatives)


def label(identifier: str) -> str | None:
    """A licence's family: the known ones by their start, others by their name
    without a version. None for what doesn't look like an identifier."""
    known = next((f for f in FAMILIES if re.match(rf"{f}(?![a-z])", identifier)), None)
    if known or identifier in PLAIN:
        return known or identifier
    m = VERSIONED.match(identifier)
    return m[1].split("-")[0] if m else None


class Scanner:
    def __init__(self) -> None:
        self.notices = ahocorasick.Automaton()
        for phrase, name in [*BASE.items(), *NOTICES.items()]:
            self.notices.add_word(f" {phrase} ", (phrase, name, phrase in BASE))
        self.notices.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(f"{tag}:", tag)
        self.tags.make_automaton()

    def scan(self, raw: bytes) -> tuple:
        low = raw.lower()
        words = WORD.findall(low)
        flat = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace") if words else ""
        base, labels, starts, evidence = set(), set(), [], 0.0
        seen, count = 0, -1
        hits = []
        for end, (phrase, name, is_base) in self.notices.iter(flat):
            hits.append((end - len(phrase) - 1, name, is_base))
        for at, name, is_base in sorted(hits):
            count += flat.count(" ", seen, at + 1)
            seen = at + 1
            labels.add(name)
            evidence += 0.5
            if is_base:
                base.add(name)
                starts.append(count)
        expressions = []
        text = low.decode("utf-8", "replace")
        last = stop = -1
        for end, _ in self.tags.iter(text):
            if end == last:
                continue
            last = end
            if stop <= end:  # an expression ends with its line
                stop = text.find("\n", end + 1)
                stop = len(text) if stop < 0 else stop
            parsed = expression(text, end + 1, stop)
            if not parsed:
                continue
            found = {x for i in parsed[0] if (x := label(i))}
            if found:
                labels |= found
                evidence += 1.0
                expressions.append(parsed[1])
        score = 1.0 - 0.5**evidence if evidence else 0.0
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        rows = [(d, *scanner.scan(raw.as_py())) for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw"))]
        c = list(zip(*rows)) or [()] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(c, _SCHEMA)], schema=_SCHEMA)


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score and expressions (each tag's alternatives,
    "a and b or c"; an expression of over 64 alternatives as it is written).

    score rises with the evidence: 1 - 0.5^(notice phrases / 2 + expressions).
    Null and empty texts have no words, empty labels and score 0; phrases may
    overlap and each place counts; malformed expressions give their longest
    well-formed start; rows that repeat an id are scanned each; null ids are
    kept; extra columns are ignored; an empty table gives an empty result.
    """
    raw = docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")).select("doc_id", bytes_of().alias("raw"))
    return raw.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>")
