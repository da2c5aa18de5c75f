"""Approximate nearest neighbours by balanced posting lists (operator 8): queries are the rows whose id is divisible by ``every`` (all by default).

Every vector is indexed.  Centroids come from k-means, about ``LIST_SIZE`` vectors each, with a penalty on lists that were
longer than the mean; they are fitted on rows chosen by a hash: all up to ``FIT_LEAST``, then ``FIT`` for each centroid.  A vector is posted to its nearest
list and, if it lies near a boundary (within ``1 + BOUNDARY`` times the least distance), to further ones, nearest first, ``REPLICAS`` in all, but to none whose
centroid is nearer to that of a list that it is in than to the vector: that list lies in the same direction and is read with the first.
Lists longer than ``PART_SIZE`` are stored in parts.

A query visits the lists whose centroids are within ``1 + ratio`` times the distance of the list with which its nearest lists hold more than k vectors (so a
vector that is a list by itself looks beyond it), in all of their parts, and more where those hold too few vectors.  The centroids are searched through an in-memory neighbour graph, entered at the best of its pivots and expanded while nodes lie within the ratio, or,
where they are few or the ratio takes in so many that the walk costs more, by a product with all.  Lists travel to shards, neighbouring lists to the same one; a query
travels once to each shard that holds a list of its, not once to each list, and leaves it with its ``k`` best.  In a shard a list is skipped where its radius
proves that it holds nothing nearer.  Neighbours of all shards are merged, each id once.

Ratios are set for each scale: queries for which that distance is the same but for a factor of 2 ** 0.5.  Of each scale, ``PROBES`` queries (all, if there are no more) have
their exact neighbours found by a scan of all vectors; the ratio is the least of ``RATIOS`` at which they find ``RECALL`` of them,
and a share ``RECALL`` of the probes half of their own.  So a few sparse vectors among
many dense ones are measured by themselves.  This fits the index on a bounded sample, and measures recall against brute force on the data at hand.

Distances are Euclidean.  There are at most ``MOST_CENTROIDS`` centroids, which bounds what is broadcast;
more vectors than that many lists hold make longer lists, in more parts.

Defined cases: rows with a null id, a null or empty vector, a vector with a null or non-finite value, or of
another length than most take no part (neither as query nor as neighbour); rows that share an id are one vector (the least);
equal vectors are neighbours at distance 0; ties go to the smaller id; with k or fewer other vectors all of them are
neighbours; an empty table, or one without a query, has an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .sampling import bounded
from .scratch import written

K = 10
LIST_SIZE, MOST_CENTROIDS, PART_SIZE, ROUNDS = 1024, 1 << 16, 2048, 4
BOUNDARY, REPLICAS, DEGREE, BALANCE = 0.05, 3, 16, 0.1
PROBES, RECALL = 256, 0.95
RATIOS = (0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0, 2.0, np.inf)
BATCH, NEAR, ENTRIES, CELLS = 512, 8, 4, 1 << 22
FIT, FIT_LEAST = 64, 1 << 16
FLAT, ROWS, SHARD_BYTES = 2048, 2048, 96 << 20
SCHEMA = "vec_id long, rank int, neighbour_id long, distance double"
f32 = np.float32


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0)


@dataclass
class Graph:
    """Centroids, the graph of their nearest neighbours in both directions, and pivots from which a search starts."""

    centroids: np.ndarray
    first: np.ndarray  # edges of node i: to[first[i] : first[i + 1]]
    to: np.ndarray
    pivots: np.ndarray
    heads: np.ndarray
    cell: np.ndarray  # nodes near head i: node[cell[i] : cell[i + 1]]
    node: np.ndarray
    wide: float = np.inf  # from this ratio on, a product with all centroids costs less than a walk

    @classmethod
    def build(cls, centroids: np.ndarray) -> Graph:
        """Edges to the nearest of those centroids that share one of the ``NEAR`` nearest cells, so that work grows with n ** 1.5."""
        n = len(centroids)
        a, b = [np.arange(n)], [(np.arange(n) + 1) % n]  # a ring through all nodes
        few = min(n, 4 * int(np.sqrt(n)) + 1)
        heads = np.unique(np.linspace(0, n - 1, few).astype(np.int64))
        node, cell = cls._cells(centroids, heads)
        for source, target in cls._near(centroids, node, cell) if n > 1 else ():
            a.append(source)
            b.append(target)
        a, b = np.concatenate([*a, *b]), np.concatenate([*b, *a])
        edges = np.unique(a * n + b)
        # pivots by farthest-first choice: a centroid far from the others is one
        pivots, away, norms = [0], np.full(n, np.inf, dtype=f32), (centroids**2).sum(axis=1)
        for _ in range(few - 1):
            away = np.minimum(away, norms - 2 * (centroids @ centroids[pivots[-1]]) + norms[pivots[-1]])
            pivots.append(int(away.argmax()))
        return cls(centroids, np.searchsorted(edges // n, np.arange(n + 1)), edges % n, np.unique(pivots), heads, cell, node, 0.0 if n <= FLAT else np.inf)

    @staticmethod
    def _cells(x: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes by cell, and where each cell begins; a cell is a head with the nodes that have it among their NEAR nearest."""
        m = min(NEAR, len(heads))
        cell = np.concatenate([np.argpartition(squared(x[low : low + BATCH], x[heads]), m - 1, axis=1)[:, :m] for low in range(0, len(x), BATCH)])
        order = np.argsort(cell.ravel(), kind="stable")
        return order // m, np.searchsorted(cell.ravel()[order], np.arange(len(heads) + 1))

    @staticmethod
    def _near(x: np.ndarray, node: np.ndarray, edge: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(node, neighbour): the DEGREE nearest in each cell."""
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(len(edge) - 1):
            own = node[edge[k] : edge[k + 1]]
            if len(own) < 2:
                continue
            degree = min(DEGREE, len(own) - 1)
            for low in range(0, len(own), BATCH):
                d = squared(x[own[low : low + BATCH]], x[own])
                d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
                to = np.argpartition(d, degree - 1, axis=1)[:, :degree]
                best.append((np.repeat(own[low : low + BATCH], degree), own[to].ravel(), np.take_along_axis(d, to, axis=1).ravel()))
        if best:
            at, to, d = (np.concatenate(c) for c in zip(*best, strict=True))
            _, one = np.unique(at * len(x) + to, return_index=True)
            at, to, d = at[one], to[one], d[one]
            order = np.lexsort((d, at))
            at, to = at[order], to[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < DEGREE
            yield at[keep], to[keep]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, distance) of the NEAR nearest for each row, nearest first: among all, or, of many, among the cells of the row's ENTRIES nearest heads."""
        m = min(NEAR, len(self.centroids))
        node, dist = np.zeros((len(x), m), np.int64), np.full((len(x), m), np.inf, f32)

        def keep(rows: np.ndarray | slice, nodes: np.ndarray) -> None:
            d = squared(x[rows], self.centroids[nodes])
            few = min(m, len(nodes))
            best = np.argpartition(d, few - 1, axis=1)[:, :few]
            found, far = np.concatenate([node[rows], nodes[best]], axis=1), np.concatenate([dist[rows], np.take_along_axis(d, best, axis=1)], axis=1)
            order = np.lexsort((far, found), axis=1)
            found, far = np.take_along_axis(found, order, axis=1), np.take_along_axis(far, order, axis=1)
            far[:, 1:][found[:, 1:] == found[:, :-1]] = np.inf  # of a node in two cells, one
            order = np.lexsort((found, far), axis=1)[:, :m]
            node[rows], dist[rows] = np.take_along_axis(found, order, axis=1), np.take_along_axis(far, order, axis=1)

        if len(self.centroids) <= FLAT:
            for low in range(0, len(x), BATCH):
                keep(slice(low, low + BATCH), np.arange(len(self.centroids)))
        else:
            d, enter = squared(x, self.centroids[self.heads]), min(ENTRIES, len(self.heads))
            head = np.argpartition(d, enter - 1, axis=1)[:, :enter].ravel()
            order = np.argsort(head, kind="stable")
            edge = np.searchsorted(head[order], np.arange(len(self.heads) + 1))
            for k in np.flatnonzero(np.diff(edge)):
                keep(order[edge[k] : edge[k + 1]] // enter, self.node[self.cell[k] : self.cell[k + 1]])
        return node, np.sqrt(dist)

    def within(self, queries: np.ndarray, ratio: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``search``; from the ratio ``wide`` on by a product with all centroids."""
        if ratio < self.wide:
            return self.search(queries, ratio, floor)
        found, step = [], max(1, CELLS // len(self.centroids))
        floor = np.zeros(len(queries), f32) if floor is None else floor.astype(f32)
        for low in range(0, len(queries), step):
            d = np.sqrt(squared(queries[low : low + step], self.centroids))
            at, node = np.nonzero(d <= np.maximum(d.min(axis=1), floor[low : low + step])[:, None] * f32(1 + ratio)) if np.isfinite(ratio) else np.divmod(np.arange(d.size), d.shape[1])
            order = np.lexsort((node, d[at, node], at))
            found.append((at[order] + low, node[order], d[at[order], node[order]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, f32))

    def search(self, queries: np.ndarray, ratio: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, centroid, distance) of centroids within ``1 + ratio`` times the query's least distance (or its ``floor``, if that is more), by query and distance.

        As many queries at a time as could look at CELLS centroids.
        """
        step = max(1, CELLS // len(self.centroids))
        parts = [self._search(queries[low : low + step], ratio, np.zeros(1, f32) if floor is None else floor[low : low + step].astype(f32)) for low in range(0, len(queries), step)]
        at = [a + low for (a, _, _), low in zip(parts, range(0, len(queries), step), strict=True)]
        return (np.concatenate([*at, np.zeros(0, np.int64)]), *(np.concatenate([*(p[i] for p in parts), np.zeros(0, kind)]) for i, kind in ((1, np.int64), (2, f32))))

    def _search(self, queries: np.ndarray, ratio: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries walk together; what is kept is one entry for each centroid that a query has looked at."""
        q, n = len(queries), len(self.centroids)
        norms, own = (self.centroids**2).sum(axis=1), (queries**2).sum(axis=1)
        start = np.sqrt(squared(queries, self.centroids[self.pivots]))
        key, dist = (np.arange(q)[:, None] * n + self.pivots).ravel(), start.ravel()
        opened, best = np.zeros(len(key), dtype=bool), start.min(axis=1)
        widest = 1 + ratio if np.isfinite(ratio) else np.inf
        within = lambda: dist <= (np.maximum(best, floor) * f32(widest))[key // n] if np.isfinite(widest) else np.ones(len(key), dtype=bool)
        enter = min(ENTRIES, len(self.pivots))  # the nearest pivots, then their surroundings
        frontier = np.sort((np.arange(q)[:, None] * len(self.pivots) + np.argpartition(start, enter - 1, axis=1)[:, :enter]).ravel())
        while len(frontier):
            opened[frontier] = True
            at, node = np.divmod(key[frontier], n)
            size = self.first[node + 1] - self.first[node]
            fresh = np.unique(np.repeat(at, size) * n + self.to[tx.ranges(self.first[node], size)])
            place = np.searchsorted(key, fresh)
            new = key[np.minimum(place, len(key) - 1)] != fresh
            fresh, place = fresh[new], place[new]
            at, node = np.divmod(fresh, n)
            far = np.empty(len(fresh), dtype=f32)
            for low in range(0, len(fresh), 1 << 16):
                a, c = at[low : low + (1 << 16)], node[low : low + (1 << 16)]
                far[low : low + len(a)] = np.sqrt(np.maximum(own[a] + norms[c] - 2 * np.einsum("ij,ij->i", queries[a], self.centroids[c]), 0))
            np.minimum.at(best, at, far)
            key, dist, opened = np.insert(key, place, fresh), np.insert(dist, place, far), np.insert(opened, place, False)
            frontier = np.flatnonzero(within() & ~opened)
        found = np.flatnonzero(within())
        at, node = np.divmod(key[found], n)
        order = np.lexsort((node, dist[found], at))
        return at[order], node[order], dist[found][order]


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(f32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), f32)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at least (the last has what is left)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of ``rows`` (id, v), by id."""
    got = rows.select("id", "v").toArrow().sort_by("id").combine_chunks()
    return got.column("id").to_numpy(), matrix(pa.concat_arrays(got.column("v").chunks) if got.num_rows else pa.array([], pa.list_(pa.float32())))


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """(id, v): usable vectors, one for each id, of the most frequent length; and their number.  Vectors move only where an id repeats."""
    v = F.col(vector_column).cast("array<float>")
    one = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('infinity'))")
    twice = one.groupBy("id").count().where("count > 1").select("id")
    if not twice.isEmpty():
        one = written(one.join(twice, "id", "left_anti").unionByName(one.join(twice, "id").groupBy("id").agg(F.min("v").alias("v"))), "vectors")
    size = one.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return one.where(F.size("v") == (size.n if size else 0)), size["count"] if size else 0


def centroids(vectors: DataFrame, n: int) -> np.ndarray:
    """Balanced k-means: ``ROUNDS`` rounds of assignment and means over rows chosen by a hash, all up to FIT_LEAST, then FIT for each centroid."""
    k = max(1, min(MOST_CENTROIDS, -(-n // LIST_SIZE)))
    share = max(FIT_LEAST, FIT * k) / n
    fit = written(vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, share)))), "fit")
    middle = arrays(bounded(fit, k, "id"))[1].copy()
    size = np.ones(len(middle))
    d = middle.shape[1]
    for _ in range(ROUNDS if len(middle) > 1 else 0):
        graph, excess = Graph.build(middle), np.maximum(size / size.mean() - 1, 0).astype(f32)
        shared = vectors.sparkSession.sparkContext.broadcast((graph, excess))

        def assign(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            graph, excess = shared.value
            total: dict[int, np.ndarray] = {}
            for batch in gathered(batches):
                x = matrix(batch.column(1))
                node, dist = graph.nearest(x)
                cost = np.where(dist <= dist[:, :1] * f32(1 + BALANCE), dist * (1 + BALANCE * excess[node]), np.inf)
                mine = node[np.arange(len(x)), cost.argmin(axis=1)]
                order = np.argsort(mine, kind="stable")
                found, first = np.unique(mine[order], return_index=True)
                sums = np.add.reduceat(np.append(x, np.ones((len(x), 1), f32), axis=1)[order].astype(np.float64), first)
                for c, part in zip(found, sums, strict=True):
                    total[c] = total.get(c, 0) + part
            if total:
                yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], names=["c", "s"])

        got = tx.map_batches(fit.select("id", "v"), assign, "c int, s array<double>").groupBy("c").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(d + 1)]).alias("s")).toArrow().combine_chunks()
        size = np.zeros(len(middle))
        if got.num_rows:
            c, sums = got.column("c").to_numpy(), np.concatenate([x.flatten().to_numpy() for x in got.column("s").chunks]).reshape(got.num_rows, -1)
            size[c], middle[c] = sums[:, -1], sums[:, :-1] / sums[:, -1:]
    return middle


def lists_of(graph: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): where each vector is posted, its nearest list first."""
    node, dist = graph.nearest(x)
    chosen = np.zeros(node.shape, dtype=bool)
    chosen[:, 0] = True
    near = np.isfinite(dist) & (dist <= dist[:, :1] * f32(1 + BOUNDARY))
    for j in range(1, node.shape[1]):
        rows = np.flatnonzero(near[:, j] & (chosen.sum(axis=1) < REPLICAS))
        for i in range(j):
            apart = ((graph.centroids[node[rows, i]] - graph.centroids[node[rows, j]]) ** 2).sum(axis=1)
            rows = rows[~chosen[rows, i] | (apart > dist[rows, j] ** 2)]
        chosen[rows, j] = True
    at, place = np.nonzero(chosen)
    return at, node[at, place]


def posted(vectors: DataFrame, graph) -> DataFrame:  # noqa: ANN001
    """(list, first, id, v): a row for each list that a vector is in; ``first`` once for each vector.  ``graph``: a broadcast."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            at, node = lists_of(graph.value, matrix(batch.column(1)))
            first, rows = np.concatenate([[True], at[1:] != at[:-1]]), pa.array(at)
            yield pa.record_batch([pa.array(node.astype(np.int32)), pa.array(first), batch.column(0).take(rows), batch.column(1).take(rows)], names=["list", "first", "id", "v"])

    return written(tx.map_batches(vectors.select("id", "v"), post, "list int, first boolean, id long, v array<float>"), "postings")


def visited(graph: Graph, x: np.ndarray, ratio: np.ndarray, away: np.ndarray, size: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list) that each query reads, those within ``1 + ratio`` times ``away``, and the distance up to which it does.  Lists of ``size`` vectors that hold fewer than ``need`` in all are read with a wider ratio."""
    reach, rows, lists = np.zeros(len(x)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ratio, left = np.array(ratio, dtype=np.float64), np.arange(len(x))
    while len(left):
        few = []
        for r in np.unique(ratio[left]):
            own = left[ratio[left] == r]
            at, node, dist = graph.within(x[own], r, away[own])
            full = (np.bincount(at, weights=size[node], minlength=len(own)) >= need) | ~np.isfinite(r)
            reach[own] = np.inf if not np.isfinite(r) else np.maximum(dist[np.searchsorted(at, np.arange(len(own)))], away[own]) * (1 + r) * (1 + 1e-6)
            rows.append(own[at[full[at]]])
            lists.append(node[full[at]])
            ratio[own[~full]] = 2 * r if r < 4 else np.inf
            few.append(own[~full])
        left = np.concatenate(few)
    return np.concatenate(rows), np.concatenate(lists), reach


SCALES = 121


def distance(graph: Graph, x: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """From each query to the list with which its nearest lists hold more than k vectors (of NEAR lists, the last)."""
    node, dist = graph.nearest(x)
    enough = np.cumsum(size[node], axis=1) > k
    return dist[np.arange(len(x)), np.where(enough.any(axis=1), enough.argmax(axis=1), np.isfinite(dist).sum(axis=1) - 1)]


def scale(away: np.ndarray) -> np.ndarray:
    """Number of the scale of each query, by its ``distance``."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(2 * np.log2(away.astype(np.float64))), -60, 60).astype(np.int64) + 60


def exact(vectors: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query row, neighbour id) of the k nearest vectors, by a scan; a task keeps its k best of each query."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries.astype(np.float64), ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids = shared.value
        row, near, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for part in gathered(batches):
            found = nearest(queries, ids, matrix(part.column(1)).astype(np.float64), part.column(0).to_numpy(), k)
            row, near, d = (np.concatenate(x) for x in zip((row, near, d), found, strict=True))
            order = np.lexsort((near, d, row))
            row, near, d = row[order], near[order], d[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, near, d = row[keep], near[keep], d[keep]
        yield pa.record_batch([pa.array(row), pa.array(near), pa.array(d)], names=["q", "near", "d"])

    top = tx.map_batches(vectors.select("id", "v"), scan, "q long, near long, d double").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "near"))), 1, k).alias("top"))
    return [(r.q, n) for r in top.select("q", "top.near").collect() for n in r.near]


def probes(queries: DataFrame, graph: Graph, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of the PROBES queries (id, v) of each scale whose ids hash lowest."""
    shared = queries.sparkSession.sparkContext.broadcast((graph, size))

    def lowest(key: np.ndarray, h: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, key))
        return order[np.arange(len(key)) - np.searchsorted(key[order], key[order]) < PROBES]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in gathered(batches):
            own = batch.column(0).to_numpy()
            key, ids, h = np.append(key, scale(distance(shared.value[0], matrix(batch.column(1)), shared.value[1], k))), np.append(ids, own), np.append(h, tx.mix(own.astype(np.uint64)))
            keep = lowest(key, h)
            key, ids, h = key[keep], ids[keep], h[keep]
        yield pa.record_batch([pa.array(key), pa.array(ids)], names=["scale", "id"])

    got = tx.map_batches(queries.select("id", "v"), pick, "scale long, id long").toArrow()
    key, ids = got.column("scale").to_numpy(), got.column("id").to_numpy()
    return arrays(chosen(queries, ids[lowest(key, tx.mix(ids.astype(np.uint64)))]))


def chosen(vectors: DataFrame, ids: np.ndarray) -> DataFrame:
    """The rows with one of a bounded number of ids."""
    return vectors.join(F.broadcast(vectors.sparkSession.createDataFrame(pa.table({"id": pa.array(np.unique(ids), pa.int64())}))), "id")


def calibrate(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, graph: Graph, size: np.ndarray, k: int) -> np.ndarray:
    """For each scale, the least ratio of RATIOS that finds RECALL of the exact neighbours of its probes, and half of its own for a share RECALL of them; sets ``graph.wide``."""
    ratios = np.full(SCALES, np.inf)
    pairs = np.array(exact(vectors, queries, ids, k), dtype=np.int64).reshape(-1, 2)
    near_ids, near = arrays(chosen(vectors, pairs[:, 1]))  # k for each probe at most
    if not len(pairs):
        return ratios
    lists = len(graph.centroids)
    if lists > FLAT:
        d = np.sqrt(squared(queries[:64], graph.centroids))
        graph.wide = next((r for r in RATIOS if 2 * DEGREE * (d <= d.min(axis=1, keepdims=True) * (1 + r)).sum() >= d.size), np.inf)
    at, node = lists_of(graph, near)
    place = np.searchsorted(near_ids, pairs[:, 1])
    first, copies = np.searchsorted(at, place), np.bincount(at, minlength=len(near))[place]
    pair, where = np.repeat(np.arange(len(pairs)), copies), node[tx.ranges(first, copies)]
    away = distance(graph, queries, size, k)
    of = scale(away)
    open_ = np.unique(of)
    for ratio in RATIOS:
        probe = np.flatnonzero(np.isin(of, open_))
        row, read, _ = visited(graph, queries[probe], np.full(len(probe), ratio), away[probe], size, REPLICAS * (k + 1))
        hit = np.bincount(pair, weights=np.isin(pairs[pair, 0] * lists + where, probe[row] * lists + read), minlength=len(pairs)) > 0
        for s in open_:
            own = of[pairs[:, 0]] == s
            found, of_each = np.bincount(pairs[own, 0], weights=hit[own]), np.bincount(pairs[own, 0])
            if own.any() and hit[own].mean() >= RECALL and (2 * found >= of_each)[of_each > 0].mean() >= RECALL:
                ratios[s] = ratio
                open_ = open_[open_ != s]
        if not len(open_):
            break
    return ratios


def nearest(queries: np.ndarray, ids: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbour id, squared distance) of the k nearest other ids, ties by id."""
    out = []
    order = np.argsort(base_ids, kind="stable")
    base, base_ids = base[order], base_ids[order]
    for low in range(0, len(queries), BATCH):
        d = squared(queries[low : low + BATCH], base)
        d[ids[low : low + BATCH][:, None] == base_ids[None, :]] = np.inf
        m = min(k, d.shape[1])
        edge = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
        row, col = np.nonzero((d <= edge) & np.isfinite(d))
        by = np.lexsort((col, d[row, col], row))
        row, col = row[by], col[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        out.append((row + low, base_ids[col], d[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def layout(graph: Graph, size: np.ndarray, width: int, least: int) -> tuple[list[list[int]], int]:
    """The shards of each list's parts, and how many shards there are: runs of neighbouring lists of about SHARD_BYTES, but ``least`` shards where there are as many parts."""
    parts = np.maximum(1, -(-size.astype(np.int64) // PART_SIZE))
    heads = graph.centroids[graph.heads]
    axis = np.linalg.svd(heads - heads.mean(axis=0), full_matrices=False)[2][0]
    head = np.concatenate([squared(graph.centroids[low : low + BATCH], heads).argmin(axis=1) for low in range(0, len(size), BATCH)])
    order = np.lexsort((graph.centroids @ axis, head, (heads @ axis)[head]))
    load = np.repeat((size / parts)[order], parts[order])
    n = int(min(len(load), max(least, -(-4 * width * size.sum() // SHARD_BYTES))))
    shard = np.minimum((np.cumsum(load) - load / 2) * n // max(1, load.sum()), n - 1).astype(int)
    ends = np.cumsum(parts[order])
    found: list[list[int]] = [[] for _ in size]
    for i, end in zip(order, ends, strict=True):
        found[i] = shard[end - parts[i] : end].tolist()
    return found, n


class Shard:
    """Vectors of some lists, and the k nearest of them to queries."""

    def __init__(self, graph: Graph, lists: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        """Rows come by list and id.  Of equal vectors in a list only the k + 1 with the least ids can be neighbours; the others are left out."""
        keep = np.concatenate([low + self._first(x[low:high], k + 1) for low, high in self._runs(lists)])
        self.ids, self.x, self.k = ids[keep], x if len(keep) == len(x) else x[keep], k
        self.runs = list(self._runs(lists[keep]))
        self.centroids = graph.centroids[[lists[keep[low]] for low, _ in self.runs]]
        self.norms = np.concatenate([((self.x[low:high] - c) ** 2).sum(axis=1) for (low, high), c in zip(self.runs, self.centroids, strict=True)])
        self.radius = np.array([np.sqrt(self.norms[low:high].max()) for low, high in self.runs])

    @staticmethod
    def _runs(lists: np.ndarray) -> Iterator[tuple[int, int]]:
        edge = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
        yield from zip(edge[:-1], edge[1:], strict=True)

    @staticmethod
    def _first(x: np.ndarray, most: int) -> np.ndarray:
        """Rows without those that have ``most`` equal ones before them."""
        h = (x.view(np.uint32) * tx.powers(0x2545F4914F6CDD1D, x.shape[1])).sum(axis=1, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        place = np.arange(len(x)) - np.searchsorted(h[order], h[order])
        like = order[np.searchsorted(h[order], h[order])]
        drop = np.flatnonzero(place >= most)
        drop = drop[(x[order[drop]] == x[like[drop]]).all(axis=1)]
        return np.delete(np.arange(len(x)), order[drop])

    def find(self, ids: np.ndarray, q: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, neighbour id, squared distance): the k nearest in the lists that lie within reach; all of equally near ones with the least ids."""
        away = np.sqrt(squared(q, self.centroids))
        row, near, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bound = np.full(len(q), np.inf)  # no neighbour is farther
        for one in np.argsort(away.mean(axis=0)):
            (low, high), c = self.runs[one], self.centroids[one]
            rows = np.flatnonzero((away[:, one] <= reach) & (away[:, one] * (1 - 1e-4) - self.radius[one] * (1 + 1e-4) <= np.sqrt(bound)))
            for start in range(low, high if len(rows) else low, PART_SIZE):
                end = min(high, start + PART_SIZE)
                own, base = q[rows] - c, self.x[start:end] - c
                norms = (own**2).sum(axis=1)
                d = norms[:, None] + self.norms[start:end] - 2 * (own @ base.T)
                slack = 4e-6 * (norms + self.norms[start:end].max())  # what products may be off by
                free = np.flatnonzero(~np.isfinite(bound[rows]))
                if len(free) and end - start > self.k:  # one of the k + 1 may be the query itself
                    bound[rows[free]] = np.maximum(np.partition(d[free], self.k, axis=1)[:, self.k], 0) + slack[free]
                at, col = np.nonzero(d <= (bound[rows] + slack).astype(f32)[:, None])
                at, col = rows[at], col + start
                other = self.ids[col] != ids[at]
                at, col = at[other], col[other]
                if not len(at):
                    continue
                far = np.concatenate([((q[at[i : i + ROWS]].astype(np.float64) - self.x[col[i : i + ROWS]]) ** 2).sum(axis=1) for i in range(0, len(at), ROWS)])
                row, near, dist = best(np.append(row, at), np.append(near, self.ids[col]), np.append(dist, far), self.k)
                last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
                bound[row[last]] = np.minimum(bound[row[last]], dist[last])
        return row, near, dist


def best(row: np.ndarray, near: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row, each id once, by row, distance and id."""
    order = np.lexsort((dist, near, row))
    row, near, dist = row[order], near[order], dist[order]
    one = np.concatenate([[True], (row[1:] != row[:-1]) | (near[1:] != near[:-1])]) if len(row) else np.zeros(0, bool)
    row, near, dist = row[one], near[one], dist[one]
    order = np.lexsort((near, dist, row))
    row, near, dist = row[order], near[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], near[keep], dist[keep]


def answered(batches: Iterator[pa.RecordBatch], graph: Graph, k: int) -> Iterator[pa.RecordBatch]:
    """(id, near, d) from rows (shard, kind, list, id, v, reach), by shard: its vectors (kind 0), then its queries (kind 1), which are streamed."""
    at, held, ready = None, [], None
    for batch in gathered(batches):
        mark = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1], [True]]))
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            part = batch.slice(low, high - low)
            ids, x = part.column(3).to_numpy(), matrix(part.column(4))
            if mark[low] // 2 != at:
                at, held, ready = mark[low] // 2, [], None
            if mark[low] % 2 == 0:
                held.append((part.column(2).to_numpy(), ids, x.copy()))
                continue
            if ready is None and held:
                ready = Shard(graph, *(np.concatenate(c) for c in zip(*held, strict=True)), k)
                held = []
            if ready is None:  # its lists are empty
                continue
            row, near, d = ready.find(ids, x, part.column(5).to_numpy())
            own, lengths = np.unique(row, return_counts=True)
            yield pa.record_batch([pa.array(ids[own]), tx.list_array(near, lengths), tx.list_array(d, lengths)], names=["id", "near", "d"])


def neighbours(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other vectors that the lists hold for each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    usable, n = clean(vectors, id_column, vector_column)
    if n == 0:
        return spark.createDataFrame([], SCHEMA)
    graph = Graph.build(centroids(usable, n))
    first = spark.sparkContext.broadcast(graph)
    postings = posted(usable, first)
    size = np.zeros(len(graph.centroids))
    for r in postings.groupBy("list").count().collect():  # a row per centroid
        size[r["list"]] = r["count"]
    base = postings.where("first").select("id", "v")
    queries = base.where(F.pmod("id", F.lit(every)) == 0)
    ids, x = probes(queries, graph, size, k)
    if not len(ids):
        return spark.createDataFrame([], SCHEMA)
    ratios, need = calibrate(base, ids, x, graph, size, k), REPLICAS * (k + 1)
    shards, parts = layout(graph, size, x.shape[1], 2 * spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast((graph, ratios, size, np.concatenate([[0], np.cumsum([len(s) for s in shards])]), np.concatenate([np.array(s) for s in shards])))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ratios, size, edge, shard = shared.value
        for batch in gathered(batches):
            x = matrix(batch.column(1))
            away = distance(graph, x, size, k)
            at, node, reach = visited(graph, x, ratios[scale(away)], away, size, need)
            lengths = np.diff(edge)[node]
            to = np.unique(np.repeat(at, lengths) * parts + shard[tx.ranges(edge[node], lengths)])
            for low in range(0, len(to), ROWS):
                row = to[low : low + ROWS] // parts
                yield pa.record_batch([pa.array((to[low : low + ROWS] % parts).astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(reach[row])], names=["shard", "id", "v", "reach"])

    sent = tx.map_batches(queries, send, "shard int, id long, v array<float>, reach double").selectExpr("shard", "1 kind", "-1 list", "id", "v", "reach")
    where = F.broadcast(spark.createDataFrame(list(enumerate(shards)), "list int, shards array<int>"))  # a number for each part of a list
    lists = postings.join(where, "list").selectExpr("shards[pmod(xxhash64(id), size(shards))] shard", "0 kind", "list", "id", "v", "cast(null as double) reach")
    rows = lists.union(sent).repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "kind", "list", "id")
    found = tx.map_batches(rows, lambda b: answered(b, shared.value[0], k), "id long, near array<long>, d array<double>")
    return merged(found, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id from ``found`` (id, near, d), a row for each shard it read; of copies of a neighbour, which REPLICAS lists hold at most, the nearest counts."""
    every = found.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("d", "near")))), 1, REPLICAS * k).alias("x"))
    near = F.transform("x", lambda y: y["near"])
    top = every.select("id", F.slice(F.filter("x", lambda y, i: F.array_position(near, y["near"]) == i + 1), 1, k).alias("top"))
    return top.select(F.col("id").alias("vec_id"), F.posexplode("top").alias("rank", "x")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("x.near").alias("neighbour_id"), F.sqrt(F.col("x.d").cast("double")).alias("distance"))
