"""Operator 2: approximate nearest neighbours by NN-descent.

Vectors with equal values are one node that lists its smallest ids, so a mass of
copies is one row. Nodes are dealt by hash into parts that fit a task. There
NN-descent makes a neighbour graph: the first lists come from random-projection
trees, and each round compares a node with neighbours of its neighbours and
reverse neighbours. Queries visit all parts and walk each graph greedily: of
the best nodes seen, those not opened yet are opened, until nothing better turns
up. What the parts found is put together by exact cosines.

Only vectors and what was found are shuffled: graphs and walks stay in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialize

_EDGES = "a long, b long, s float"
#: Most nodes of a part: some 300 MB in a task at 64 dimensions.
MOST = 150_000
#: Tables are dealt into up to so many parts of EASY nodes, for work side by side.
SPREAD, EASY = 6, 8_192


def _pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops what takes no part; the vector as float64 bytes."""
    for batch in batches:
        batch = batch.filter(pc.and_kleene(batch.column("vec_id").is_valid(), pc.greater(pc.list_value_length(batch.column("embedding")), 0)))
        lists, ids = batch.column("embedding"), batch.column("vec_id").to_numpy(zero_copy_only=False)
        values, size = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size  # nulls have become NaN
        which, raw = [], []
        for dim in np.unique(size).tolist():
            at = np.flatnonzero(size == dim)
            m = values[start[at][:, None] + np.arange(dim)].astype(np.float64) + 0.0  # -0.0 and 0.0 are one value
            good = np.isfinite(m).all(axis=1) & m.any(axis=1)
            which.append(ids[at[good]])
            raw += [row.tobytes() for row in m[good]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which) if which else [], pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "vec"])


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision, which graph and search use."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _rows_of(vectors: DataFrame) -> DataFrame:
    """vec_id, vec and node, the vector's hash of 64 bits."""
    rows = vectors.select(column(vectors, "vec_id", "bigint"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_pack_vectors, "vec_id long, vec binary")
    return rows.withColumn("node", F.xxhash64("vec"))


def nodes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """node, vec, ids: distinct vectors with the `keep` smallest of their ids,
    found without gathering a vector's copies: ranks of (node, vec_id) alone are
    cut by a window after a first cut within hashed parts, and one row brings
    the vector."""
    rows = _rows_of(vectors)
    known = rows.select("node", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    one = Window.partitionBy("node", "salt").orderBy("vec_id")
    two = Window.partitionBy("node").orderBy("vec_id")
    few = known.withColumn("r", F.row_number().over(one)).filter(F.col("r") <= keep)
    few = few.withColumn("r", F.row_number().over(two)).filter(F.col("r") <= keep)
    few = few.groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vec_id", F.col("ids")[0])
    return few.join(rows, ["node", "vec_id"]).dropDuplicates(["node", "vec_id"]).select("node", "vec", "ids")


_LOW = np.uint64((1 << 32) - 1)


def _bits(s: np.ndarray) -> np.ndarray:
    """Similarities as integers of the same order, in the upper half of 64 bits."""
    return (np.maximum(s, np.float32(-1.5)) + np.float32(3)).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)


def _from_bits(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(32)).astype(np.uint32).view(np.float32) - np.float32(3)


def _leaves(u: np.ndarray, block: int, r: np.random.Generator) -> np.ndarray:
    """One random-projection tree: (leaves, width) of nodes, at most `block` in a
    leaf, filled up with -1. Each part is halved along the line of two of its
    nodes until it is small enough."""
    n = len(u)
    order, edges = r.permutation(n), np.array([0, n])
    while (edges[1:] - edges[:-1]).max() > block:
        sizes = edges[1:] - edges[:-1]
        group = np.repeat(np.arange(len(sizes)), sizes)
        x = order[edges[:-1] + r.integers(0, sizes)]
        y = order[edges[:-1] + r.integers(0, sizes)]
        line = u[x] - u[y]
        at = np.empty(n, np.float32)
        for i in range(0, n, 65_536):
            at[i : i + 65_536] = np.einsum("ij,ij->i", u[order[i : i + 65_536]], line[group[i : i + 65_536]])
        order = order[np.lexsort((at, group))]
        edges = np.unique(np.concatenate((edges, edges[:-1] + sizes // 2)))
    sizes = edges[1:] - edges[:-1]
    out = np.full((len(sizes), int(sizes.max())), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = order
    return out


def _merged(old: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Lists (similarity, node, whether new), best first, with more nodes offered;
    -1 is none. A node that is there already stays as it was."""
    key = (ids.astype(np.uint64) << np.uint64(33)) | np.uint64(1 << 32) | (_bits(s) >> np.uint64(32))
    key[ids < 0] = 0
    was = ((old & _LOW) >> np.uint64(1) << np.uint64(33)) | (old >> np.uint64(32))
    key = np.sort(np.concatenate((was, key), axis=1), axis=1)
    double = key[:, 1:] >> np.uint64(33) == key[:, :-1] >> np.uint64(33)
    back = (key << np.uint64(32)) | (key >> np.uint64(32))
    back[:, 1:][double] = 0
    back[key & _LOW == 0] = 0
    return np.sort(back, axis=1)[:, ::-1][:, :k]


def _reversed(to: np.ndarray, n: int, most: int) -> np.ndarray:
    """(n, most): of each node's reverse links, best first, as many as `most`; -1
    is none. Lists come best first."""
    b = to.T.ravel()  # all first links, all second ones, ...
    a = np.tile(np.arange(n), to.shape[1])
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    start = np.searchsorted(b, np.arange(n))
    rank = np.arange(len(b)) - start[b]
    out = np.full((n, most), -1, np.int32)
    out[b[rank < most], rank[rank < most]] = a[rank < most]
    return out


def descend(u: np.ndarray, k: int, still: float, lists: int, block: int, reverse: int, meet: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """NN-descent over the rows of u: neighbours, best first (-1 is none), and
    their similarities. First lists come from `lists` random-projection trees.
    In a round a node draws `meet` of its neighbours and of its `reverse` nearest
    reverse neighbours, new ones first, and is compared with what those have
    drawn; rounds go on until at most a share of `still` of the links is new."""
    n = len(u)
    r = np.random.default_rng(n)
    k = min(k, n - 1)
    if k < 1:
        return np.full((n, 1), -1, np.int32), np.zeros((n, 1), np.float32)
    held = np.zeros((n, k), np.uint64)
    for _ in range(lists):
        leaves = _leaves(u, max(2, block), r)
        width = leaves.shape[1]
        step = max(1, 2_000_000 // (width * max(width, u.shape[1])))
        for i in range(0, len(leaves), step):
            own = leaves[i : i + step]
            x = u[own]
            s = x @ x.transpose(0, 2, 1)
            s[:, np.arange(width), np.arange(width)] = -2
            s[np.broadcast_to(own[:, None, :] < 0, s.shape)] = -2
            s, rows = s[own >= 0], own[own >= 0]
            few = min(k, width)
            top = np.argpartition(-s, few - 1, axis=1)[:, :few]
            ids, best = np.repeat(own, (own >= 0).sum(axis=1), axis=0)[np.arange(len(rows))[:, None], top], np.take_along_axis(s, top, 1)
            ids[best < -1.5] = -1
            held[rows] = _merged(held[rows], ids, best, k)
    step = max(1, 4_000_000 // (meet * meet * max(16, u.shape[1])))
    while True:
        to = ((held & _LOW) >> np.uint64(1)).astype(np.int32)
        to[held == 0] = -1
        new = (held & np.uint64(1)).astype(bool)
        back = _reversed(to, n, reverse)
        drawn = np.full((n, meet), -1, np.int32)
        for i in range(0, n, 16_384):
            both = np.concatenate((to[i : i + 16_384], back[i : i + 16_384]), axis=1)
            weight = r.random(both.shape, np.float32)
            weight[:, : k] += new[i : i + 16_384]
            weight[both < 0] = -1
            few = min(meet, both.shape[1])
            top = np.argpartition(-weight, few - 1, axis=1)[:, :few]
            drawn[i : i + 16_384, :few] = np.take_along_axis(both, top, 1)
        held &= ~np.uint64(1)
        fresh = 0
        for i in range(0, n, step):
            mine = np.arange(i, min(n, i + step))
            ids = drawn[drawn[mine]]
            ids[drawn[mine] < 0] = -1
            ids = np.concatenate((ids.reshape(len(mine), -1), drawn[mine]), axis=1)
            ids[ids == mine[:, None]] = -1
            s = np.matmul(u[ids], u[mine][:, :, None])[:, :, 0]
            held[mine] = _merged(held[mine], ids, s, k)
            fresh += int((held[mine] & np.uint64(1)).sum())
        if fresh <= still * np.count_nonzero(held):
            break
    to = ((held & _LOW) >> np.uint64(1)).astype(np.int32)
    to[held == 0] = -1
    return to, _from_bits(held)


def walk(u: np.ndarray, links: np.ndarray, asked: np.ndarray, own: np.ndarray, pool: int, open_: int, keep: int) -> np.ndarray:
    """Greedy search: for each row of asked the `keep` nearest nodes found, best
    first, -1 where there are fewer. From the best of some spread nodes and its
    own (-1: none), a step opens the `open_` best of the `pool` best seen that aren't open, until all
    of them are. links: (nodes, most), -1 is none."""
    n, many = links.shape
    pool = max(pool, keep)
    begin = np.random.default_rng(n).choice(n, min(n, 4 * pool), replace=False)
    out = np.full((len(asked), keep), -1, np.int64)
    size = int(max(8, min(256, 50_000_000 // n)))
    seen = np.zeros((size, n + 1), np.uint16)
    flat = seen.reshape(-1)
    columns = np.arange(open_ * many, dtype=np.uint16) + np.uint16(1)
    for first in range(0, len(asked), size):
        q = asked[first : first + size]
        seen[:] = 0
        seen[:, n] = 1
        seen[:, begin] = 1
        best = _bits(q @ u[begin].T) | (begin.astype(np.uint64) << np.uint64(1))
        at = own[first : first + size]
        there = (at >= 0) & (seen[np.arange(len(q)), at] == 0)
        extra = np.where(there, _bits(np.einsum("ij,ij->i", u[at], q)) | (at.astype(np.uint64) << np.uint64(1)), np.uint64(0))
        seen[np.arange(len(q))[there], at[there]] = 1
        best = np.sort(np.concatenate((best, extra[:, None]), axis=1), axis=1)[:, ::-1][:, :pool]
        if best.shape[1] < pool:
            best = np.concatenate((best, np.zeros((len(q), pool - best.shape[1]), np.uint64)), axis=1)
        live = np.arange(len(q))
        while len(live):
            mine = best[live]
            closed = (mine & np.uint64(1)).astype(bool) | (mine == 0)
            pick = ~closed & (np.cumsum(~closed, axis=1) <= open_)
            going = pick.any(axis=1)
            if not going.all():
                live, mine, pick = live[going], mine[going], pick[going]
                if not len(live):
                    break
            at = np.argsort(~pick, axis=1, kind="stable")[:, :open_]
            nodes = ((np.take_along_axis(mine, at, 1) & _LOW) >> np.uint64(1)).astype(np.int64)
            ids = links[nodes]
            ids[~np.take_along_axis(pick, at, 1)] = -1
            ids = ids.reshape(len(live), -1)
            ids[ids < 0] = n
            mine |= pick.astype(np.uint64)
            place = live[:, None] * (n + 1) + ids
            column_ = np.broadcast_to(columns[: ids.shape[1]], ids.shape)
            unseen = flat[place] == 0
            flat[place[unseen]] = column_[unseen]
            unseen &= flat[place] == column_
            row, _ = np.nonzero(unseen)
            found = ids[unseen]
            keys = np.zeros(ids.shape, np.uint64)
            keys[unseen] = _bits(np.einsum("ij,ij->i", u[found], q[live[row]])) | (found.astype(np.uint64) << np.uint64(1))
            best[live] = np.sort(np.concatenate((mine, keys), axis=1), axis=1)[:, ::-1][:, :pool]
        top = best[:, :keep]
        got = ((top & _LOW) >> np.uint64(1)).astype(np.int64)
        got[top == 0] = -1
        out[first : first + size, : got.shape[1]] = got
    return out


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by part, which is a number below `parts`: a part to a task, sorted."""
    # numbers of which each has a partition of its own
    own = rows.sparkSession.range(40 * parts + 40).select(F.col("id").cast("int").alias("deal")).groupBy(F.pmod(F.hash("deal"), F.lit(parts)).alias("p")).agg(F.min("deal").alias("deal")).collect()
    deal = [r.deal for r in sorted(own, key=lambda r: r.p)]
    if len(deal) == parts > 1:
        rows = rows.withColumn("part", F.element_at(F.array(*map(F.lit, deal)), (F.col("part") + 1).cast("int")))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "kind")


def _parts_for(nodes: DataFrame, most: int) -> int:
    """Parts of at most about `most` nodes of 64 dimensions, fewer of more."""
    total, size = nodes.agg(F.count("*"), F.max(F.length("vec"))).first()
    return max(1, -(-total * max(64, (size or 0) // 8) // (64 * most)), min(SPREAD, total // EASY))


def _part_of(parts: int):
    return F.pmod(F.xxhash64("node", F.lit("part")), F.lit(parts)).cast("int").alias("part")


def _by_part(start, ask):
    """Gathers the nodes of each part, start(nodes, first ids, vecs) makes
    something of them by dimension, and ask(that, queries, vecs) answers a
    batch's queries. Both return a list of record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, made = None, {}, None

        def begun():
            out = {}
            for dim in list(held):
                nodes, firsts, raw = held.pop(dim)
                out[dim] = start(np.array(nodes), np.array(firsts), np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1))
            return out

        for batch in batches:
            asked: dict[int, tuple[list, list]] = {}
            for p, kind, node, first, vec in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "node", "first", "vec"))):
                if p != part:
                    if part is not None:
                        made = begun() if made is None else made
                        yield from ask(made, asked)
                    part, made, asked = p, None, {}
                if kind == 0:
                    for x, y in zip(held.setdefault(len(vec), ([], [], [])), (node, first, vec)):
                        x.append(y)
                else:
                    if made is None:
                        made = begun()
                    for x, y in zip(asked.setdefault(len(vec), ([], [])), (node, vec)):
                        x.append(y)
            if asked:
                yield from ask(made, asked)
        if part is not None and made is None:
            yield from ask(begun(), {})

    return run


def _edges(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], names=["a", "b", "s"])


def _graph_rows(nodes: DataFrame, parts: int) -> DataFrame:
    return nodes.select(_part_of(parts), F.lit(0).alias("kind"), "node", F.col("ids")[0].alias("first"), "vec")


def build_graph(nodes: DataFrame, k: int = 24, still: float = 0.1, lists: int = 12, block: int = 2048, reverse: int = 24, most: int = MOST) -> DataFrame:
    """(a, b, s): the neighbour graphs of the parts by NN-descent, in rounds
    until at most a share of `still` of the links is new; first lists from
    `lists` random-projection trees with leaves of at most `block` nodes. Every
    vector is in one graph."""
    parts = _parts_for(nodes, most)

    def start(ids, firsts, vecs):
        to, s = descend(_unit(vecs), k, still, lists, block, reverse)
        on = to >= 0
        return _edges(np.repeat(ids, on.sum(axis=1)), ids[to[on]], s[on])

    return _dealt(_graph_rows(nodes, parts), parts).mapInArrow(_by_part(start, lambda made, asked: list(made.values())), _EDGES)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, in double precision."""
    with np.errstate(all="ignore"):
        c = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
    wide = lambda m: (np.abs(m).max(axis=1) > 1e100) | (np.abs(m).max(axis=1) < 1e-100)
    odd = np.flatnonzero(~np.isfinite(c) | wide(x) | wide(y))  # squares out of range
    if len(odd):
        x, y = (m[odd] / np.abs(m[odd]).max(axis=1, keepdims=True) for m in (x, y))
        c[odd] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
    return c


_FOUND = pa.schema([("q", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("s", pa.float64())])


def _search_part(k: int, pool: int, open_: int, graph: dict):
    """Graph of a part, then the k + 1 nearest nodes found for each query."""

    def start(ids, firsts, vecs):
        u = _unit(vecs)
        to, _ = descend(u, **graph)
        links = np.concatenate((to, _reversed(to, len(to), 32)), axis=1)
        return ids, firsts, vecs, u, links, np.argsort(ids)

    def ask(made, asked):
        for size, (qs, raw) in asked.items():
            if size not in made:
                continue
            ids, firsts, vecs, u, links, order = made[size]
            qs, qvec = np.array(qs), np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
            at = order[np.minimum(np.searchsorted(ids, qs, sorter=order), len(ids) - 1)]
            own = np.where(ids[at] == qs, at, -1)
            # the pool is that of 8,192 nodes and grows with the root of more; a few more
            # than k are kept, as single precision may swap close ones
            wide = round(pool * max(1.0, len(ids) / 8_192) ** 0.5)
            to = walk(u, links, _unit(qvec), own, wide, open_, 2 * k + 4)
            row, _ = np.nonzero(to >= 0)
            to = to[to >= 0]
            s = np.concatenate([_cosines(vecs[to[i : i + 20_000]], qvec[row[i : i + 20_000]]) for i in range(0, len(to), 20_000)])
            by = np.lexsort((firsts[to], -s, row))
            row, to, s = row[by], to[by], s[by]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            top = rank <= k
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((qs[row[top]], ids[to[top]], firsts[to[top]], s[top]), _FOUND)], schema=_FOUND)

    return _by_part(start, ask)


def search(vectors: DataFrame, every: int = 50, k: int = 5, pool: int = 64, open_: int = 8, most: int = MOST, links: int = 24, still: float = 0.1, lists: int = 12, block: int = 2048, reverse: int = 24) -> DataFrame:
    """The k nearest rows of each query (vec_id divisible by `every`) by cosine:
    query_id, rank, vec_id, score.

    In each part a query starts from some spread nodes, and its own where it is.
    A step opens the `open_` best nodes among the best it has seen that aren't
    open yet, until all of them are: `pool` nodes up to 8,192 in a part, growing
    with the root of more. Parts have at most about `most` nodes.

    Rows with null ids, null, empty or zero vectors, null or non-finite
    components take no part; vectors of another length are never near; rows
    that repeat an id and vector count once; extra columns are ignored; with
    fewer candidates than k all are returned; an empty table gives an empty
    result. Equal scores go by vec_id: a distinct vector carries its k + 1
    smallest ids, more can never be among the k nearest.
    """
    nodes = materialize(nodes_of(vectors, k + 1), "op2-nodes")
    parts = _parts_for(nodes, most)
    queries = materialize(_rows_of(vectors.filter(column(vectors, "vec_id", "bigint") % every == 0)).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).distinct(), "op2-queries")
    asked = nodes.join(queries.select(F.col("q").alias("node")).distinct(), "node", "left_semi")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "node", F.lit(None).cast("long").alias("first"), "vec")
    rows = _dealt(_graph_rows(nodes, parts).unionByName(asked), parts)
    graph = {"k": links, "still": still, "lists": lists, "block": block, "reverse": reverse}
    found = rows.mapInArrow(_search_part(k, pool, open_, graph), "q long, b long, first long, s double")
    # the k + 1 nearest nodes, the query's own among them, hold the k nearest rows
    w = Window.partitionBy("q").orderBy(F.desc("s"), "first", "b")
    found = materialize(found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("q", "b", "s"), "op2-found")
    out = queries.join(found, "q").join(nodes.select(F.col("node").alias("b"), "ids"), "b").select("query_id", "s", F.explode("ids").alias("vec_id")).filter("query_id != vec_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    return out.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("s").alias("score"))
