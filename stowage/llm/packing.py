"""Operator 9: vector bin packing of token pieces.

Examples have three sizes: tokens, segments (one each) and loss-bearing tokens.
A bin is filled by the dot-product heuristic: of the examples that fit it in
every dimension, take the one whose size vector has the largest dot product
with the bin's remaining capacity, both relative to the limits. Where nothing
whole fits and examples may be cut, the open bin is filled up by cutting the
longest example. What the last bins hold is dealt out over powers of two, which
need no padding.

Examples of one partition are packed together, in blocks of bounded size: no
shuffle, no driver, and a lost task is repeated alone.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, column

LIMITS = (2048, 1024, 2048)


class Bins:
    """Open examples, kept by token count, and the bins made of them."""

    def __init__(self, limits: tuple[int, int, int] = LIMITS, cut: bool = True, look: int = 16):
        self.limits, self.cut, self.look = limits, cut, look
        self.keys: list[tuple[int, int]] = []
        self.items: dict[int, tuple] = {}
        self.next = 0

    def add(self, item: tuple) -> None:
        """item: (tokens, loss, payload, start); loss-bearing tokens come last
        in an example, so a cut of its tail takes of them first."""
        bisect.insort(self.keys, (item[0], self.next))
        self.items[self.next] = item
        self.next += 1

    def take(self, at: int) -> tuple:
        return self.items.pop(self.keys.pop(at)[1])

    def _best(self, room: list[int]) -> int | None:
        """Of the longest examples that still fit, and the shortest, the one
        with the largest dot product."""
        end = bisect.bisect_right(self.keys, (room[0], 1 << 62))
        if not end or room[1] < 1:
            return None
        free = [r / m for r, m in zip(room, self.limits)]
        best, top = None, -1.0
        tried = [*range(end - 1, max(end - 1 - self.look, -1), -1), 0]
        for at in tried:
            tokens, loss = self.items[self.keys[at][1]][:2]
            if loss > room[2]:
                continue
            dot = tokens / self.limits[0] * free[0] + free[1] / self.limits[1] + loss / self.limits[2] * free[2]
            if dot > top:
                best, top = at, dot
        return best

    def fill(self) -> list[tuple]:
        """The pieces of the next bin."""
        room, out = list(self.limits), []
        while self.keys and room[0] and room[1]:
            at = self._best(room)
            if at is None:
                if not self.cut or not room[2]:
                    break
                tokens, loss, payload, start = self.take(len(self.keys) - 1)
                n = min(room[0], max(tokens - loss, 0) + room[2], tokens)
                before = min(max(0, n - (tokens - loss)), loss)
                self.add((tokens - n, loss - before, payload, start + n))
                item = (n, before, payload, start)
            else:
                item = self.take(at)
            out.append(item)
            room = [room[0] - item[0], room[1] - 1, room[2] - item[1]]
        return out

    def total(self) -> int:
        return sum(k[0] for k in self.keys)


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """A bin that isn't full, as bins of powers of two without padding."""
    total, out, queue = sum(p[0] for p in pieces), [], sorted(pieces, key=lambda p: -p[0])
    for bit in reversed(range(total.bit_length())):
        size = 1 << bit
        if not total & size:
            continue
        bin_ = []
        while size:
            n, loss, payload, start = queue.pop(0)
            k = min(n, size)
            if k < n:
                queue.insert(0, (n - k, max(0, loss - k), payload, start + k))
            bin_.append((k, min(loss, k), payload, start))
            size -= k
        out.append(bin_)
    return out


_tokenizers: dict = {}


class Tokenizer:
    """The byte-level BPE of byte_bpe_50k: ids as of `tokenizers` with special
    tokens off, by the ranks of the same vocabulary."""

    def __init__(self, path: str | None):
        import public_tokenizers as P
        import tiktoken

        with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ids = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def get(cls, path: str | None) -> "Tokenizer":
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]


def _emit(bins: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
    rows = []
    for sequence, pieces in bins:
        offset = 0
        for n, _, (doc_id, ids, base, total), start in pieces:
            rows.append((doc_id, start, n, zlib.crc32(ids[start - base : start - base + n].tobytes()), total, sequence, offset))
            offset += n
    c = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _pack(limits: tuple[int, int, int], end_id: int, path: str | None, hold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, open_ = Tokenizer.get(path), Bins(limits)
        sequence = TaskContext.get().partitionId() << 32
        for batch in batches:
            full: list[tuple[int, list[tuple]]] = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw")):
                ids = np.array([*bpe.ids(raw.as_py().decode("utf-8", "replace")), end_id], "<u4")
                whole = min(limits[0], limits[2])
                at = 0
                while len(ids) - at >= whole:
                    full.append((sequence, [(whole, whole, (doc_id, ids, 0, len(ids)), at)]))
                    sequence += 1
                    at += whole
                if at < len(ids):
                    # only the rest of the document is kept
                    open_.add((len(ids) - at, len(ids) - at, (doc_id, ids[at:].copy(), at, len(ids)), at))
            while len(open_.keys) > hold:
                full.append((sequence, open_.fill()))
                sequence += 1
            yield _emit(full)
        full = []
        while open_.keys:
            pieces = open_.fill()
            for bin_ in [pieces] if sum(p[0] for p in pieces) == limits[0] else powers(pieces):
                full.append((sequence, bin_))
                sequence += 1
        yield _emit(full)

    return run


def pack_documents(docs: DataFrame, limits: tuple[int, int, int] = LIMITS, end_id: int = 1, tokenizer_path: str | None = None, hold: int = 4000) -> DataFrame:
    """Packs every document's tokens and an end token into sequences of at most
    limits[0] tokens, limits[1] segments and limits[2] loss-bearing tokens (of
    documents, all are). One row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    `hold` examples of a task stay open to choose from. Null and empty texts are
    an end token alone; long texts fill sequences of their own; rows that repeat
    an id are packed each; null ids are kept; extra columns are ignored; an
    empty table gives an empty result. tokenizer_path: ranks as in tiktoken
    files, else the public byte_bpe_50k vocabulary.
    """
    raw = docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")).select("doc_id", bytes_of().alias("raw"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return raw.mapInArrow(_pack(limits, end_id, tokenizer_path, hold), kind)


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = LIMITS, hold: int = 4000) -> DataFrame:
    """Places whole examples (example_id, tokens, loss_tokens) of instruction
    data, uncut, under the three limits; returns example_id, sequence_id,
    offset. Examples over a limit get a null sequence_id; null sizes count as 0.
    Repeated rows are placed each; an empty table gives an empty result."""
    rows = examples.select(column(examples, "example_id", "bigint"), F.coalesce(column(examples, "tokens", "bigint"), F.lit(0)).alias("tokens"), F.coalesce(column(examples, "loss_tokens", "bigint"), F.lit(0)).alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        open_, sequence = Bins(limits, cut=False), TaskContext.get().partitionId() << 32

        def close(down_to: int) -> pa.RecordBatch:
            nonlocal sequence
            out = []
            while len(open_.keys) > down_to:
                offset = 0
                for n, _, example, _ in open_.fill():
                    out.append((example, sequence, offset))
                    offset += n
                sequence += 1
            c = list(zip(*out)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["example_id", "sequence_id", "offset"])

        for batch in batches:
            over = []
            for example, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if tokens > limits[0] or loss > limits[2] or limits[1] < 1:
                    over.append(example)
                else:
                    open_.add((tokens, loss, example, 0))
            none = pa.nulls(len(over), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(over, pa.int64()), none, none], names=["example_id", "sequence_id", "offset"])
            yield close(hold)
        yield close(0)

    return rows.mapInArrow(run, "example_id long, sequence_id long, offset long")


def conversations_as_examples(conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Examples of pack_examples from (conv_id, turn, role, text): tokens of all
    turns, loss-bearing those of the assistant's; every turn ends in one more.
    Token counts are summed on the map side; null roles bear no loss."""
    rows = conversations.select(column(conversations, "conv_id", "bigint"), column(conversations, "role", "string"), column(conversations, "text", "string"))
    rows = rows.select("conv_id", F.coalesce(F.lower("role") == "assistant", F.lit(False)).alias("loss"), bytes_of().alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Tokenizer.get(tokenizer_path)
        for batch in batches:
            n = pa.array([len(bpe.ids(x.as_py().decode("utf-8", "replace"))) + 1 for x in batch.column("raw")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("loss"), n], names=["conv_id", "loss", "n"])

    counted = rows.mapInArrow(run, "conv_id long, loss boolean, n long")
    return counted.groupBy(F.col("conv_id").alias("example_id")).agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("loss"), F.col("n")).otherwise(0)).alias("loss_tokens"))
