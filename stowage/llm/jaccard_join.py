"""Operator 3: n-gram Jaccard join in size-banded tiles.

A document is the set of its distinct word shingles (64-bit hashes). Documents
with equal sets are one class from the start; everything below works on
distinct sets.

* Bands: sizes are cut into bands with ratio 1/t, so linked sets stand in the
  same or in neighbouring bands. Within a band, linked sets differ in at most d
  shingles, hence of d + 1 + z segments of the hash space at least z + 1 have
  the same shingles in both. A tile is (band, segment, the segment's shingles).
  A set with at most z empty segments gives no rows for them, as one of the
  z + 1 that it shares isn't empty then. Common passages do not make large
  tiles, as a segment mixes some 1/(1-t) shingles from all over the text.
* A hashed bitmap of each set bounds overlaps from above by bit counts:
  |x & y| <= (|x| + |y| - bits(bx ^ by)) / 2. Bitmaps are kept by set and are as
  wide as the set needs; a wider one is folded to the other's width.
* First each set is compared with the smallest set of each of its tiles, and of
  those that the bound lets through the best is decided by intersecting the
  sorted arrays. So groups of copies become components without pairs.
* Tiles that still hold several components are compared whole, in blocks of
  bounded size, a task for each pair of blocks: each set outside the tile's
  largest component emits its best partners by the bound in other components.
  All that are emitted and not decided yet are decided. Where a set had more
  than it emitted, the block is looked at again, with more partners a set each
  time, until no block has an undecided pair between two components. So no link
  between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, bytes_of, column, discard, documents, materialize, mix64, partitions_for, words
from .components import components

#: Least width of a bitmap, and most members of a block of a tile.
BITS, BLOCK = 512, 2048
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the
    whole sequence; empty without words."""
    w = words(raw)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(n, len(w))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * _P[0] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def set_id(s: np.ndarray) -> int:
    d = xxhash.xxh3_64_intdigest(s.tobytes(), len(s))
    return d - (1 << 64) if d >> 63 else d


def bitmap(s: np.ndarray) -> bytes:
    """A bit is set where an odd number of shingles falls on it. The width is a
    power of two, over the number of shingles."""
    width = max(BITS, 1 << len(s).bit_length())
    odd = np.bincount((s >> np.uint64(24)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """The bitmap of the same set at a smaller width (in 64-bit words)."""
    out = np.frombuffer(bits, np.uint64)
    while len(out) > width:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


class Bands:
    """The bands of sizes for a threshold num/den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold must be over 0 and at most 1")
        self.num, self.den, self.ends = num, den, [1]
        self._schemes: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> int:
        while self.ends[-1] <= n:
            e = self.ends[-1]
            self.ends.append(max(e + 1, -(-e * self.den // self.num)))
        return int(np.searchsorted(self.ends, n, side="right"))

    def scheme(self, band: int) -> tuple[int, int]:
        """(segments, z): d + 1 + z segments, d the largest difference of linked
        sets of at most the band's largest size, |x ^ y| <= (|x| + |y|)(den -
        num)/(den + num). z is about as many segments as the smallest sets that
        use the scheme (the band below does too) leave empty, or 0 where that
        would take more segments than d + 1 again."""
        if band not in self._schemes:
            self.of(1)
            while len(self.ends) <= band:
                self.of(self.ends[-1])
            need = 2 * (self.ends[band] - 1) * (self.den - self.num) // (self.den + self.num) + 1
            least = self.ends[max(0, band - 2)]

            def enough(z: int) -> bool:
                m = need + z
                empty = m * (1 - 1 / m) ** least
                return z >= empty + 2 * empty**0.5

            z = next((z for z in range(need + 1) if enough(z)), 0)
            self._schemes[band] = (need + z, z)
        return self._schemes[band]

    def linked(self, x: int, y: int, both: int) -> bool:
        return self.den * both >= self.num * (x + y - both)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, maps = [], [], []
            for raw in batch.column("raw"):
                s = shingle_set(raw.as_py(), n)
                ids.append(set_id(s))
                sizes.append(len(s))
                maps.append(bitmap(s) if len(s) else None)
            own = [x for x in batch.schema.names if x != "raw"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in own), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], names=[*own, "sid", "n", "bits"])

    return run


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The tiles of a set: those of its own band, and of the next for partners
    that are larger."""
    out, own = [], bands.of(len(s))
    for band in (own, own + 1):
        m, z = bands.scheme(band)
        cut = np.searchsorted((s >> np.uint64(32)).astype(np.float64), np.arange(1, m) * (2.0**32 / m)).astype(np.int64)
        cut = np.concatenate(([0], cut, [len(s)]))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(s * _P[1]), dtype=np.uint64)))
        seg = sums[cut[1:]] - sums[cut[:-1]] + (cut[1:] - cut[:-1]).astype(np.uint64) * _P[2]
        tile = mix64(seg ^ mix64(np.arange(m, dtype=np.uint64) * _P[0] + np.uint64(band)))
        filled = cut[1:] > cut[:-1]
        out.append(tile[filled] if m - int(filled.sum()) <= z else tile)
    return np.concatenate(out)


def _tiles(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in batches:
            sigs, ids, held = [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids))], names=["tile", "sid"])

            for raw in batch.column("raw"):
                s = shingle_set(raw.as_py(), n)
                if not len(s):
                    continue
                i = set_id(s)
                if i in seen:  # copies in one task need one set of rows
                    continue
                if len(seen) < 1_000_000:
                    seen.add(i)
                sigs.append(signatures(s, bands))
                ids.append(np.full(len(sigs[-1]), i, np.int64))
                held += len(sigs[-1])
                if held > 100_000:
                    yield out()
                    sigs, ids, held = [], [], 0
            if sigs:
                yield out()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, hub, sid) of tiles that several sets share; rows come sorted by
    tile and set. The hub is the tile's smallest set. Only the last row is held
    back, however large a tile is."""
    last: tuple[int, int, int] | None = None  # tile, hub, sid of the last row
    waits = False  # the last row is its tile's first and isn't given out yet
    for batch in batches:
        t, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(t):
            continue
        before = (last[0], last[2]) if last else (t[0], s[0])
        prior_t, prior_s = np.append(before[0], t[:-1]), np.append(before[1], s[:-1])
        fresh = (t != prior_t) | (s != prior_s)  # copies of a set are one row
        fresh[0] |= last is None
        t, s = t[fresh], s[fresh]
        if not len(t):
            continue
        first = np.append(last is None or t[0] != last[0], t[1:] != t[:-1])
        at = np.maximum.accumulate(np.where(first, np.arange(len(t)), -1))
        hub = np.where(at >= 0, s[at], last[1] if last else 0)
        out = ~first | np.append(~first[1:], False)
        rows = [t[out], hub[out], s[out]]
        if waits and not first[0]:
            rows = [np.append(x, y) for x, y in zip(last, rows)]
        last, waits = (int(t[-1]), int(hub[-1]), int(s[-1])), bool(first[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["tile", "hub", "sid"])


def _most(x: np.ndarray, y: np.ndarray, differ: np.ndarray, bands: Bands) -> np.ndarray:
    """Upper bounds of the overlap of sets of x and y shingles whose bitmaps
    differ in so many bits, -1 where that is too little for a link."""
    both = np.minimum((x + y - differ) // 2, np.minimum(x, y))
    return np.where(bands.den * both >= bands.num * (x + y - both), both, -1)


def _bounded(num: int, den: int):
    """Pairs that the bound lets through, with the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            differ = []
            for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()):
                width = min(len(x), len(y)) // 8
                differ.append(int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum()))
            both = _most(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), np.array(differ, np.int64), bands)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both)], names=["a", "b", "most"])
            yield out.filter(pa.array(both >= 0))

    return run


def walk(sid: np.ndarray, size: np.ndarray, bits: list[bytes], label: np.ndarray, side: np.ndarray | None, bands: Bands, partners: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of a block of a tile that the bound lets through, between sets of
    different labels and, if given, different sides: of each set outside the
    largest component those with up to `partners` others, those with the largest
    bounds; and whether that left any out."""
    width = min(map(len, bits)) // 8
    maps = np.array([folded(x, width) for x in bits])
    values, counts = np.unique(label, return_counts=True)
    todo = np.flatnonzero(label != values[counts.argmax()])
    pairs: list[tuple[int, int]] = []
    more, step = False, max(1, 1_000_000 // maps.size)
    for at in range(0, len(todo), step):
        rows = todo[at : at + step]
        differ = np.bitwise_count(maps[rows, None] ^ maps[None]).sum(axis=2, dtype=np.int64)
        apart = label[rows, None] != label[None]
        if side is not None:
            apart &= side[rows, None] != side[None]
        both = np.where(apart, _most(size[rows, None], size[None], differ, bands), -1)
        passing = (both >= 0).sum(axis=1)
        more |= bool((passing > partners).any())
        for r in np.flatnonzero(passing).tolist():
            best = np.argsort(-both[r], kind="stable")[: min(partners, passing[r])]
            pairs += [(int(sid[rows[r]]), int(j)) for j in sid[best]]
    return [(min(p), max(p)) for p in pairs], more


def _walks(num: int, den: int, partners: int):
    """Rows come sorted by tile and block. A block that has more than its pairs
    gives a row without a pair too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held = Bands(num, den), None

        def done(t: pa.Table) -> pa.RecordBatch:
            c = {x: t.column(x).to_numpy() for x in ("tile", "lo", "hi", "sid", "n", "label", "chunk")}
            bits = t.column("bits").to_pylist()
            edge = np.flatnonzero(np.append(True, (c["tile"][1:] != c["tile"][:-1]) | (c["lo"][1:] != c["lo"][:-1]) | (c["hi"][1:] != c["hi"][:-1])))
            rows = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), t.num_rows]):
                lo, hi = int(c["lo"][a]), int(c["hi"][a])
                pairs, more = walk(c["sid"][a:b], c["n"][a:b], bits[a:b], c["label"][a:b], c["chunk"][a:b] if lo < hi else None, bands, partners)
                where = (int(c["tile"][a]), lo, hi)
                rows += [(*where, *p) for p in pairs] + [(*where, None, None)] * more
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["tile", "lo", "hi", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            last = [held.column(x)[-1].as_py() for x in ("tile", "lo", "hi")]
            same = np.logical_and.reduce([held.column(x).to_numpy() == v for x, v in zip(("tile", "lo", "hi"), last)])
            cut = int(same.argmax())  # the last block may go on
            if cut:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield done(held)

    return run


def _arrays(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, arrays = [], []
            for key, raw in zip(batch.column("hash").to_pylist(), batch.column("raw")):
                if key in seen:  # a repeated row
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                s = shingle_set(raw.as_py(), n)
                ids.append(set_id(s))
                arrays.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(arrays, pa.binary())], names=["sid", "arr"])

    return run


def _decide(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                small, big = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                ok.append(bands.linked(len(x), len(y), int((big[at] == small).sum())))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


class _Join:
    """The state of a join: sets by sid, their arrays as far as they were needed,
    labels of sets that are linked, refused pairs."""

    def __init__(self, raw: DataFrame, sets: DataFrame, n: int, num: int, den: int):
        self.raw, self.sets, self.n, self.num, self.den = raw, sets, n, num, den
        self.arrays: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.refused: DataFrame | None = None

    def passing(self, pairs: DataFrame) -> DataFrame:
        """(a, b, most) of the pairs that the bound lets through."""
        of = lambda c: self.sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
        return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(_bounded(self.num, self.den), "a long, b long, most long")

    def decide(self, pairs: DataFrame) -> None:
        """Decides pairs (a, b) exactly, and joins components by the links."""
        ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
        if self.arrays is not None:
            ends = ends.join(self.arrays.select("sid"), "sid", "left_anti")
        ends = materialize(ends, "op3-ends")
        if self.arrays is None or not ends.isEmpty():
            wanted = self.sets.join(ends, "sid", "left_semi").select(F.col("rep.hash").alias("hash"), F.col("rep.doc_id").alias("rep"))
            texts = self.raw.join(wanted, (self.raw["hash"] == wanted["hash"]) & self.raw.doc_id.eqNullSafe(wanted.rep)).select(self.raw["hash"], "raw")
            fresh = materialize(texts.mapInArrow(_arrays(self.n), "sid long, arr binary"), "op3-arrays")
            self.arrays = self.arrays.unionByName(fresh) if self.arrays is not None else fresh
        discard(ends)
        of = lambda c, x: self.arrays.select(F.col("sid").alias(c), F.col("arr").alias(x))
        both = pairs.select("a", "b").join(of("a", "x"), "a").join(of("b", "y"), "b")
        decided = materialize(both.select("a", "b", "x", "y").mapInArrow(_decide(self.num, self.den), "a long, b long, linked boolean").distinct(), "op3-decided")
        no, yes = (decided.filter(x).select("a", "b") for x in ("not linked", "linked"))
        self.refused = self.refused.unionByName(no) if self.refused is not None else no
        if self.labels is None:
            self.labels = materialize(components(yes), "op3-labels")
        elif not yes.isEmpty():
            # new links join components, not sets
            old = self.labels
            found = materialize(components(self.labelled(self.labelled(yes, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))), "op3-found")
            moved = old.join(found.select(F.col("id").alias("label"), F.col("label").alias("least")), "label", "left").select("id", F.coalesce("least", "label").alias("label"))
            self.labels = materialize(moved.unionByName(found.join(old.select("id"), "id", "left_anti").select("id", "label")), "op3-labels")
            discard(old)
            discard(found)

    def labelled(self, df: DataFrame, sid: str, name: str) -> DataFrame:
        """df with the label of its column sid."""
        return df.join(self.labels.select(F.col("id").alias(sid), F.col("label").alias(name)), sid, "left").withColumn(name, F.coalesce(name, sid))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Groups documents whose sets of distinct n-word shingles have a Jaccard
    similarity of at least num/den, by way of others if need be. A row per input
    row: doc_id, n_shingles, component_id (smallest doc_id of the group).

    Null and empty texts and texts of white space have no shingles and stand
    alone; fewer than n words are one shingle; equal sets are linked; rows that
    repeat an id are documents of their own with that id; a null id never is a
    component_id unless all ids of the group are null; very long texts are read
    whole; extra columns are ignored; an empty table gives an empty result.
    """
    grouped = _grouped(docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")).select("doc_id", bytes_of().alias("raw")), n, num, den)
    least = grouped.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(least, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(raw: DataFrame, n: int, num: int, den: int, block: int | None = None) -> DataFrame:
    """The columns of raw (doc_id, raw and others) but raw, with the set's sid
    and n, and the label of its component."""
    raw = raw.withColumn("hash", F.xxhash64("raw"))
    own = [f"{name} {kind}" for name, kind in raw.dtypes if name != "raw"]
    rows = materialize(raw.mapInArrow(_sets(n), ", ".join([*own, "sid long, n long, bits binary"])), "op3-rows")
    sets = rows.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct("hash", "doc_id")).alias("rep"))
    state = _Join(raw, materialize(sets, "op3-sets"), n, num, den)
    parts = partitions_for(raw.sparkSession)
    tiles = raw.select("raw").mapInArrow(_tiles(n, num, den), "tile long, sid long").repartition(parts, "tile").sortWithinPartitions("tile", "sid")
    shared = materialize(tiles.mapInArrow(_shared, "tile long, hub long, sid long"), "op3-tiles")
    # each set with the best of the smallest sets of its tiles
    star = state.passing(shared.filter("hub < sid").select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct())
    state.decide(materialize(star.groupBy("b").agg(F.max(F.struct("most", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"), "op3-star"))
    members = _open_blocks(state, shared, block or BLOCK)
    partners = 4
    while True:
        found = materialize(members.repartition(parts, "tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi").mapInArrow(_walks(num, den, partners), "tile long, lo long, hi long, a long, b long"), "op3-pairs")
        pairs = found.filter("a is not null").select("a", "b").distinct().join(state.refused, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "op3-candidates")
        if not pairs.isEmpty():
            state.decide(pairs)
        again = found.filter("a is null").select("tile", "lo", "hi")
        if again.isEmpty():
            break
        old, rest = members, state.labelled(members.drop("label"), "sid", "label").join(again, ["tile", "lo", "hi"], "left_semi")
        members = materialize(rest.select(old.columns), "op3-members")
        for x in (old, found, pairs):
            discard(x)
        partners *= 16
    return state.labelled(rows.drop("bits"), "sid", "label")


def _open_blocks(state: _Join, shared: DataFrame, block: int) -> DataFrame:
    """Members of the tiles that hold several components, in pairs (lo, hi) of
    blocks of about `block` members each."""
    now = state.labelled(shared.select("tile", "sid"), "sid", "label")
    several = now.groupBy("tile").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).filter("x < y").select("tile", F.ceil(F.col("c") / block).cast("long").alias("blocks"))
    now = now.join(several, "tile").withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    now = now.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    now = now.select("tile", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "sid", "label")
    return materialize(now.join(state.sets.select("sid", "n", "bits"), "sid").select("tile", "lo", "hi", "chunk", "sid", "n", "bits", "label"), "op3-members")


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each group stays: that of the smallest id, nulls last; of
    different texts with that id, the one with the smallest hash. Empty texts are
    linked with nothing and all stay."""
    keyed = documents(docs).withColumn("key", F.unhex(F.md5(bytes_of())))
    found = materialize(_grouped(keyed.select("doc_id", "key", bytes_of().alias("raw")), n, num, den).select("doc_id", "key", "n", "label").filter("n > 0"), "op3-groups")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("r"), F.count("*").alias("c"))
    first = first.select(F.col("r.doc_id").alias("d"), F.col("r.key").alias("k"), (F.col("c") > 1).alias("several"))
    this = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    worded = F.col("text").isNotNull() & F.col("text").rlike(WORD_PATTERN)
    kept = keyed.filter(worded).join(first, this).drop("d", "k")
    alone, several = kept.filter("not several"), kept.filter("several").dropDuplicates(["doc_id", "key"])
    return documents(keyed.filter(~F.coalesce(worded, F.lit(False)))).unionByName(documents(alone)).unionByName(documents(several))
