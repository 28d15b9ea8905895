"""Nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, and the shards' results merged.

Rows go to shards of about SHARD_ROWS by the hash of their id.  A task builds the graph of one shard and gives it out as
flat arrays (ids, vectors, the neighbours on each layer); these rows are written once, so a lost executor costs a search,
not a graph.  Each block of queries then meets each shard, is searched in its graph, and the best of each shard are merged.

Equal vectors of a shard are one node that lists its ids, so copies crowd no neighbourhood; a search needs no more than
the k + 1 smallest ids of a node.  So that the largest inner product is also the shortest distance, vectors get one more
component that gives all of a shard the same length; the last component of a query is 0.  The graph works in single
precision with searches of many queries at a time; the scores given out are inner products of the original vectors in
double precision, and decide the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.shipping import ship

#: Rows of a shard and queries of a block; at these sizes an array of the one is about as large as one of the other.
SHARD_ROWS, BLOCK_ROWS = 16_384, 4_096
#: Neighbours of a node (twice as many on the lowest layer) and the widths of the searches that build and that answer.
LINKS, BUILD_WIDTH, WIDTH = 16, 96, 160
#: Nodes that are searched for together, candidates opened for each of them at a time.
TOGETHER, OPENED = 256, 4
INDEX = "dim long, shard long, nodes long, longest double, ids binary, starts binary, vectors binary, sizes binary, neighbours binary"


class Graph:
    """Unit of search: vectors of equal length as rows, and for each layer the nodes' neighbours, -1 where there is none.

    Nodes are in the order in which they were put in, those of high layers first: layer i holds the nodes below ``sizes[i]``.
    """

    def __init__(self, vectors: np.ndarray, sizes: list[int], neighbours: list[np.ndarray]) -> None:
        self.x, self.sizes, self.neighbours = vectors, sizes, neighbours

    def beam(self, queries: np.ndarray, entries: np.ndarray, layer: int, width: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, inner products) of the best ``width`` found for each query, best first; -1 where there are fewer.

        All queries step together: each opens its best unopened candidates until none is left among its best.
        """
        n, near = upto or self.sizes[layer], self.neighbours[layer]
        rows = np.arange(len(queries))
        nodes = np.full((len(queries), width), -1, np.int32)
        scores = np.full((len(queries), width), -np.inf, np.float32)
        opened = np.ones((len(queries), width), bool)
        nodes[:, 0], opened[:, 0] = entries, False
        scores[:, 0] = np.einsum("ij,ij->i", self.x[entries], queries)
        seen = np.zeros((len(queries), n + 1), bool)
        seen[rows, entries] = True
        seen[:, n] = True
        while len(rows):
            waiting = np.where(opened[rows], -np.inf, scores[rows])
            live = waiting.max(axis=1) > -np.inf
            rows, waiting = rows[live], waiting[live]
            if not len(rows):
                break
            take = min(OPENED, width)
            pick = np.argpartition(-waiting, take - 1, axis=1)[:, :take] if take < width else np.broadcast_to(np.arange(width), waiting.shape)
            fresh = np.take_along_axis(waiting, pick, 1) > -np.inf
            opened[rows[:, None], pick] = True
            found = near[nodes[rows[:, None], pick]]
            found[~fresh] = -1
            found = found.reshape(len(rows), -1)
            found = np.where((found < 0) | (found >= n), n, found)
            new = ~seen[rows[:, None], found]
            seen[rows[:, None], found] = True
            if take > 1:  # a node that two opened ones share counts once
                order = np.argsort(found, axis=1, kind="stable")
                ranked = np.take_along_axis(found, order, 1)
                twice = np.zeros_like(new)
                np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
                new &= ~twice
            at, place = np.nonzero(new)
            if not len(at):
                continue
            got = np.full(found.shape, -np.inf, np.float32)
            got[at, place] = np.einsum("ij,ij->i", self.x[found[at, place]], queries[rows[at]])
            every = np.concatenate((scores[rows], got), axis=1)
            best = np.argpartition(-every, width - 1, axis=1)[:, :width]
            scores[rows] = np.take_along_axis(every, best, 1)
            nodes[rows] = np.take_along_axis(np.concatenate((nodes[rows], np.where(new, found, -1)), axis=1), best, 1)
            opened[rows] = np.take_along_axis(np.concatenate((opened[rows], ~new), axis=1), best, 1)
        order = np.argsort(-scores, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)

    def descend(self, queries: np.ndarray, to: int, upto: int | None = None) -> np.ndarray:
        """The nearest node found on the layers above ``to``, from the top."""
        entries = np.zeros(len(queries), np.int32)
        for layer in range(len(self.sizes) - 1, to, -1):
            entries = self.beam(queries, entries, layer, 1 if layer > to + 1 else 8)[0][:, 0]
        return entries if upto is None else np.where(entries < upto, entries, 0)

    def search(self, queries: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of each query; searches that end with fewer than ``least`` go on from nodes they have not met."""
        nodes, scores = self.beam(queries, self.descend(queries, 0), 0, width)
        least = min(least, self.sizes[0], width)
        for i in np.flatnonzero((nodes >= 0).sum(axis=1) < least):
            while (held := nodes[i][nodes[i] >= 0]).size < least:
                entry = np.setdiff1d(np.arange(self.sizes[0]), held)[:1]
                more, got = self.beam(queries[i : i + 1], entry, 0, width)
                every, first = np.unique(np.concatenate((held, more[0][more[0] >= 0])), return_index=True)
                every_score = np.concatenate((scores[i][nodes[i] >= 0], got[0][more[0] >= 0]))[first]
                order = np.argsort(-every_score, kind="stable")[:width]
                nodes[i, : len(order)], scores[i, : len(order)] = every[order], every_score[order]
        return nodes, scores


def _diverse(x: np.ndarray, nodes: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, up to ``most`` that are nearer to the row's node than to any candidate chosen; then the best others."""
    out = np.full((len(nodes), most), -1, np.int32)
    for low in range(0, len(nodes), 256):
        some, near = nodes[low : low + 256], scores[low : low + 256]
        vectors = x[np.maximum(some, 0)]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        chosen = np.zeros(some.shape, bool)
        blocked = some < 0
        room = np.full(len(some), most)
        for j in range(some.shape[1]):
            take = ~blocked[:, j] & (room > 0)
            chosen[:, j] = take
            room -= take
            blocked |= take[:, None] & (between[:, :, j] >= near)
        rank = np.where(some < 0, 2, np.where(chosen, 0, 1)) * some.shape[1] + np.arange(some.shape[1])
        order = np.argsort(rank, axis=1)[:, :most]
        kept = np.take_along_axis(some, order, 1)
        out[low : low + 256, : kept.shape[1]] = kept
    return out


def _link_back(x: np.ndarray, near: np.ndarray, sources: np.ndarray, chosen: np.ndarray) -> None:
    """Adds each source to the neighbours of those it chose; lists that overflow are chosen anew."""
    most = near.shape[1]
    a, place = np.nonzero(chosen >= 0)
    to, source = chosen[a, place], sources[a]
    score = np.einsum("ij,ij->i", x[to], x[source])
    order = np.lexsort((-score, to))
    to, source = to[order], source[order]
    owners, first, counts = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, counts)
    row = np.repeat(np.arange(len(owners)), counts)
    offered = np.full((len(owners), most), -1, np.int32)
    good = rank < most  # of many new ones the best may be chosen
    offered[row[good], rank[good]] = source[good]
    for low in range(0, len(owners), 512):
        own, new = owners[low : low + 512], offered[low : low + 512]
        held = near[own]
        new = np.where((new[:, :, None] == held[:, None, :]).any(axis=2), -1, new)
        every = np.concatenate((held, new), axis=1)
        scores = np.where(every < 0, -np.inf, np.einsum("ijk,ik->ij", x[np.maximum(every, 0)], x[own])).astype(np.float32)
        order = np.argsort(-scores, axis=1, kind="stable")
        every, scores = np.take_along_axis(every, order, 1), np.take_along_axis(scores, order, 1)
        full = (every >= 0).sum(axis=1) > most
        kept = every[:, :most].copy()
        if full.any():
            kept[full] = _diverse(x, every[full], scores[full], most)
        near[own] = kept


def build(vectors: np.ndarray, seed: np.ndarray) -> tuple[Graph, np.ndarray]:
    """(graph, order): the graph's node i is row ``order[i]``; ``seed`` are hashes of the rows, which set their layers."""
    n = len(vectors)
    share = (seed.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    levels = np.minimum(np.floor(-np.log(np.maximum(share, 1e-12)) / np.log(LINKS)), 8).astype(int)
    order = np.lexsort((seed, -levels))
    x, levels = np.ascontiguousarray(vectors[order]), levels[order]
    sizes = [int((levels >= i).sum()) for i in range(int(levels.max(initial=0)) + 1)]
    graph = Graph(x, sizes, [np.full((m, LINKS * (1 + (i == 0))), -1, np.int32) for i, m in enumerate(sizes)])
    for layer in range(len(sizes) - 1, -1, -1):
        near, done = graph.neighbours[layer], 0
        most = near.shape[1]
        while done < sizes[layer]:
            high = min(sizes[layer], done + max(1, min(TOGETHER, done)) if done else TOGETHER)
            new = np.arange(done, high, dtype=np.int32)
            queries = x[new]
            mutual = queries @ queries.T
            mutual[np.arange(len(new)), np.arange(len(new))] = -np.inf
            width = min(BUILD_WIDTH, len(new))
            best = np.argpartition(-mutual, width - 1, axis=1)[:, :width]
            nodes, scores = new[best], np.take_along_axis(mutual, best, 1)
            nodes = np.where(scores > -np.inf, nodes, -1).astype(np.int32)
            if done:
                old, old_scores = graph.beam(queries, graph.descend(queries, layer, done), layer, BUILD_WIDTH, done)
                nodes, scores = np.concatenate((old, nodes), axis=1), np.concatenate((old_scores, scores), axis=1)
            by = np.argsort(-scores, axis=1, kind="stable")[:, :BUILD_WIDTH]
            chosen = _diverse(x, np.take_along_axis(nodes, by, 1), np.take_along_axis(scores, by, 1), most // (1 + (layer == 0)))
            near[new, : chosen.shape[1]] = chosen
            _link_back(x, near, new, chosen)
            done = high
    return graph, order


def _lengthened(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors in single precision, scaled to at most length 1, with one more component that makes it 1; and the scale."""
    peak = float(np.abs(vectors).max(initial=0.0)) or 1.0
    small = vectors / peak
    squares = np.einsum("ij,ij->i", small, small)
    longest = float(np.sqrt(squares.max(initial=0.0))) or 1.0
    rest = np.sqrt(np.maximum(0.0, 1.0 - squares / longest**2))
    return np.concatenate((small / longest, rest[:, None]), axis=1).astype(np.float32), longest * peak


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _indexed(table: pa.Table) -> pa.Table:
    """The index row of a shard."""
    table = table.sort_by("vec_id")
    vectors, ids = _matrix(table["vector"]), table["vec_id"].to_numpy().astype(np.int64)
    distinct, first, owner = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    long, longest = _lengthened(distinct)
    graph, order = build(long, _mixed(ids[first]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    nodes = place[owner.ravel()]
    by = np.argsort(nodes, kind="stable")  # ids of a node stay in order
    starts = np.concatenate(([0], np.cumsum(np.bincount(nodes, minlength=len(order)))))
    flat = np.concatenate([m.ravel() for m in graph.neighbours])
    values = [table["dim"][0].as_py(), table["shard"][0].as_py(), len(order), longest]
    packed = [ids[by], starts.astype(np.int64), distinct[order], np.array(graph.sizes, np.int64), flat]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()] + [pa.binary()] * 5
    names = ["dim", "shard", "nodes", "longest", "ids", "starts", "vectors", "sizes", "neighbours"]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip([*values, *(p.tobytes() for p in packed)], kinds)], names)


def index(rows: DataFrame) -> DataFrame:
    """One row per shard with its graph as flat arrays; ``rows`` are (dim, shard, vec_id, vector)."""
    ship(rows.sparkSession)
    return written(rows.groupBy("dim", "shard").applyInArrow(_indexed, INDEX))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, dim) of the rows that take part, one for each id: the least of its vectors."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = df.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    chosen = some.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return chosen.withColumn("dim", F.size("vector").cast("long"))


def _searcher(k: int, width: int):
    """Searches the queries of a block (right) in the graph of a shard (left)."""

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], ["query_id", "vec_id", "score"])
        row = left.slice(0, 1).to_pylist()[0]
        ids, starts, sizes = (np.frombuffer(row[c], np.int64) for c in ("ids", "starts", "sizes"))
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["nodes"], row["dim"])
        flat, near, at = np.frombuffer(row["neighbours"], np.int32), [], 0
        for i, n in enumerate(sizes.tolist()):
            m = LINKS * (1 + (i == 0))
            near.append(flat[at : at + n * m].reshape(n, m))
            at += n * m
        graph = Graph(_lengthened(vectors)[0], sizes.tolist(), near)
        asked, names, out = _matrix(right["vector"]), right["query_id"].to_numpy(), []
        unit = asked / np.abs(asked).max(axis=1)[:, None]
        unit = np.concatenate((unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None], np.zeros((len(asked), 1))), axis=1).astype(np.float32)
        for low in range(0, len(asked), TOGETHER):
            nodes, _ = graph.search(unit[low : low + TOGETHER], width, k + 1)
            q, place = np.nonzero(nodes >= 0)
            found = nodes[q, place]
            score = (vectors[found] * asked[low + q]).sum(axis=1)
            # the k + 1 smallest ids of each node, then the k best rows that are not the query
            sizes_of = np.minimum(starts[found + 1] - starts[found], k + 1)
            each = np.repeat(np.arange(len(found)), sizes_of)
            ends = np.cumsum(sizes_of)
            ident = ids[starts[found][each] + np.arange(len(each)) - np.repeat(ends - sizes_of, sizes_of)]
            q, score = low + q[each], score[each]
            other = ident != names[q]
            q, score, ident = q[other], score[other], ident[other]
            order = np.lexsort((ident, -score, q))
            q, score, ident = q[order], score[order], ident[order]
            first = np.searchsorted(q, q)
            best = np.arange(len(q)) - first < k
            out.append((names[q[best]], ident[best], score[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return search


def nearest(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH) -> DataFrame:
    """The ``k`` rows of ``df`` found nearest to each row of ``queries`` by inner product: query_id, rank, vec_id, score.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components take no part, as
    query or as candidate.  Rows that repeat an id count once, with the least vector; a query's own id is no candidate.
    Vectors of different lengths are never compared.  Equal scores go by the smaller id.  Every row is in a graph and
    every query is searched in all shards of its length; a query with fewer than ``k`` candidates gets all of them.
    Empty tables give an empty result; other columns are not read.
    """
    rows = written(usable(df, id_col, vector_col))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    graphs = index(rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "vec_id", "vector"))
    asked = written(usable(queries, id_col, vector_col))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = graphs.select("*", each(blocks).alias("block"))
    right = asked.select(
        F.col("dim").alias("of_dim"), each(shards).alias("of_shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("of_block"), F.col("vec_id").alias("query_id"), "vector"
    )
    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("of_dim", "of_shard", "of_block")).applyInArrow(_searcher(k, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
