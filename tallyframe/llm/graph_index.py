"""Nearest neighbours by a robust-pruned directed graph in every shard.

Vectors are dealt to shards of bounded size by a hash. A shard's graph grows in
batches: a greedy beam search on the graph so far proposes neighbours of every
new vector, pruning keeps the diverse ones (a candidate goes if a kept neighbour
is ``slack`` times nearer to it than the vector itself), and kept edges are
offered back to their ends, which are pruned again where they overflow. A search
enters at a few random vectors, and at those that these do not lead to, so all are
reachable.

The index is a table with one row per distinct vector, so it is written, read
back and searched like any other. A search gives every query to every shard:
index rows of a shard come first, queries then stream past them in batches, and
the nearest of all shards are merged. All distances are in double precision, those
of the result are taken anew from differences; components beyond 1e150, which no
single-precision number is, have infinite distances.

Equal vectors are one node. It keeps the smallest ids, as many as a result can
hold: no result ever shows a larger one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import stored

NODE = "shard int, node int, dims int, vec_ids array<bigint>, vector array<double>, edges array<int>, entry boolean"


@dataclass(frozen=True)
class Params:
    shard_rows: int = 8192
    degree: int = 32  # edges of a node
    build_beam: int = 64
    search_beam: int = 96
    slack: float = 1.2
    batch: int = 512  # vectors inserted, and queries searched, at once
    step: int = 4  # nodes that a search opens at once
    starts: int = 64  # entries of a shard, so that a dense group around one does not hold a search
    seed: int = 7


# ------------------------------------------------------------------ inside a shard

def _distances(points: np.ndarray, squares: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances of targets[i] to points[ids[i, :]]."""
    near = np.matmul(points[ids], targets[:, :, None])[:, :, 0]
    return np.maximum(squares[ids] - 2 * near + np.einsum("ij,ij->i", targets, targets)[:, None], 0)


def _again(ids: np.ndarray) -> np.ndarray:
    """Where an id of a row has occurred in the row before."""
    order = np.argsort(ids, axis=1, kind="stable")
    ordered = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
    return again


def beam_search(points: np.ndarray, squares: np.ndarray, edges: np.ndarray, entries: np.ndarray, targets: np.ndarray, beam: int, step: int):
    """(beam ids, their squared distances, opened ids, theirs) for every target:
    the nearest nodes met, nearest first, and all nodes whose edges were
    followed; -1 and infinity fill the rows up."""
    n = len(targets)
    seen = np.zeros((n, len(points) + 1), bool)  # the last column takes the fillers
    seen[:, -1] = True
    ids = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf)
    done = np.zeros((n, beam), bool)
    opened, opened_far = [], []

    def offer(active: np.ndarray, new: np.ndarray) -> None:
        fresh = ~seen[active[:, None], new]
        seen[active[:, None], new] = True
        d = np.where(fresh, _distances(points, squares, new, targets[active]), np.inf)
        d[_again(new)] = np.inf  # the same node from two opened ones
        every, every_far = np.concatenate([ids[active], new], 1), np.concatenate([far[active], d], 1)
        flags = np.concatenate([done[active], np.zeros_like(fresh)], 1)
        best = np.argsort(every_far, axis=1, kind="stable")[:, :beam]
        far[active] = np.take_along_axis(every_far, best, 1)
        ids[active] = np.where(np.isfinite(far[active]), np.take_along_axis(every, best, 1), -1)
        done[active] = np.take_along_axis(flags, best, 1)

    for i in range(0, len(entries), 64):
        offer(np.arange(n), np.repeat(entries[None, i : i + 64], n, 0))
    while True:
        waiting = (ids >= 0) & ~done
        active = np.flatnonzero(waiting.any(1))
        if not len(active):
            break
        # The first nodes of the beam that were not opened yet.
        first = np.argsort(~waiting[active], axis=1, kind="stable")[:, :step]
        fits = np.take_along_axis(waiting[active], first, 1)
        nodes = np.where(fits, np.take_along_axis(ids[active], first, 1), -1)
        mark = done[active]
        np.put_along_axis(mark, first, fits | np.take_along_axis(mark, first, 1), 1)
        done[active] = mark
        for_all = np.full((n, first.shape[1]), -1, np.int64)
        for_all[active] = nodes
        dist = np.full((n, first.shape[1]), np.inf)
        dist[active] = np.where(fits, np.take_along_axis(far[active], first, 1), np.inf)
        opened.append(for_all)
        opened_far.append(dist)
        offer(active, edges[nodes].reshape(len(active), -1))
    if not opened:
        return ids, far, np.zeros((n, 0), np.int64), np.zeros((n, 0))
    return ids, far, np.concatenate(opened, 1), np.concatenate(opened_far, 1)


def robust_prune(points: np.ndarray, squares: np.ndarray, own: np.ndarray, ids: np.ndarray, far: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each own[i] from ids[i, :] at the
    squared distances far[i, :]; -1 fills up. Repeated ids count once."""
    far = np.where((ids < 0) | (ids == own[:, None]), np.inf, far)
    far = np.where(_again(ids), np.inf, far)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
    width = int(np.isfinite(far).sum(1).max(initial=0))
    ids, far = ids[:, :width], far[:, :width]
    out = np.full((len(ids), degree), -1, np.int64)
    if not width:
        return out
    alive = np.isfinite(far)
    spots = points[ids]
    between = squares[ids][:, :, None] + squares[ids][:, None, :] - 2 * np.matmul(spots, spots.transpose(0, 2, 1))
    at = np.arange(len(ids))
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[at, first]
        if not some.any():
            break
        out[:, k] = np.where(some, ids[at, first], -1)
        alive &= slack * slack * between[at, first] > far
        alive[at, first] = False
    return out


def _offer_back(points, squares, edges, sources, p: Params) -> None:
    """Offer each kept edge of ``sources`` to its end as an edge back."""
    ends = edges[sources]
    rows, _ = np.nonzero(ends >= 0)
    ends, starts = ends[ends >= 0], sources[rows]
    d = squares[ends] + squares[starts] - 2 * np.einsum("ij,ij->i", points[ends], points[starts])
    order = np.lexsort((d, ends))
    ends, starts = ends[order], starts[order]
    nodes, first, count = np.unique(ends, return_index=True, return_counts=True)
    place = np.arange(len(ends)) - np.repeat(first, count)
    room = place < 2 * p.degree  # a hub takes the nearest offers
    offers = np.full((len(nodes), int(min(count.max(initial=0), 2 * p.degree))), -1, np.int64)
    offers[np.repeat(np.arange(len(nodes)), count)[room], place[room]] = starts[room]
    for i in range(0, len(nodes), p.batch):
        own = nodes[i : i + p.batch]
        every = np.concatenate([edges[own], offers[i : i + p.batch]], 1)
        every = np.where(_again(every), -1, every)
        merged = robust_prune(points, squares, own, every, _distances(points, squares, every, points[own]), p.degree, p.slack)
        # Where everything fits nothing is pruned.
        fits = (every >= 0).sum(1) <= p.degree
        packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)
        if packed.shape[1] < p.degree:
            packed = np.pad(packed, ((0, 0), (0, p.degree - packed.shape[1])), constant_values=-1)
        edges[own] = np.where(fits[:, None], packed[:, : p.degree], merged)


def grow(points: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(edges by node, entry nodes) of the graph over ``points``."""
    n = len(points)
    squares = np.einsum("ij,ij->i", points, points)
    # One filler row, so that node -1 is a place without edges.
    points, squares = np.concatenate([points, np.zeros((1, points.shape[1]), points.dtype)]), np.append(squares, 0.0)
    edges = np.full((n + 1, p.degree), -1, np.int64)
    order = np.random.default_rng(p.seed).permutation(n)
    entries = order[: p.starts]
    # The first vectors all see each other, later ones the graph before their batch.
    at = min(n, 2 * p.build_beam)
    head = order[:at]
    every = np.repeat(head[None, :], at, 0)
    edges[head] = robust_prune(points, squares, head, every, _distances(points, squares, every, points[head]), p.degree, p.slack)
    _offer_back(points, squares, edges, head, p)
    while at < n:
        own = order[at : at + min(p.batch, at)]
        _, _, ids, far = beam_search(points[:n], squares[:n], edges, entries, points[own], p.build_beam, p.step)
        edges[own] = robust_prune(points, squares, own, ids, far, p.degree, p.slack)
        _offer_back(points, squares, edges, own, p)
        at += len(own)
    return edges[:n], np.concatenate([entries, _unreached(edges, entries, n)])


def _unreached(edges: np.ndarray, entries: np.ndarray, n: int) -> np.ndarray:
    """Nodes to enter at besides ``entries``, so that every node is reached."""
    met = np.zeros(n + 1, bool)
    met[-1] = True
    more, edge = [], entries
    while True:
        while len(edge):
            met[edge] = True
            edge = np.unique(edges[edge])
            edge = edge[~met[edge]]
        if met.all():
            return np.array(more, np.int64)
        more.append(int(np.argmin(met)))
        edge = np.array(more[-1:])


# ------------------------------------------------------------------ tables

def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part, each id and vector once: not
    those whose id or vector is null, or whose vector is empty, all zeros or holds
    a component that is null, infinite or not a number."""
    found = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    whole = F.expr("vec_id IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)")
    # Plus zero makes minus zero the same component.
    return found.where(whole).select("vec_id", F.expr("transform(vector, x -> x + 0D)").alias("vector")).distinct()


def build(found: DataFrame, ids_kept: int, p: Params = Params()) -> DataFrame:
    """The index of ``found`` (vec_id, vector), one row per distinct vector:
    shard, node, dims, vec_ids (the smallest ``ids_kept``), vector, edges, entry.
    Vectors of different length are in different shards."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = (
        found.withColumn("place", place).where(F.col("place") <= ids_kept)
        .groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))
        .withColumn("dims", F.size("vector"))
    )
    shards = max(-(-found.select("vector").distinct().count() // p.shard_rows), 1)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))

    def graph(key, table):
        dims = key[1].as_py()
        ids = table.column("vec_ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i])  # the same graph on every run
        table = table.take(pa.array(order))
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        edges, entries = grow(vectors, p)
        is_entry = np.zeros(len(vectors), bool)
        is_entry[entries] = True
        lists = [e[e >= 0] for e in edges]
        return pa.table({
            "shard": table.column("shard"), "node": pa.array(np.arange(len(vectors)), pa.int32()), "dims": table.column("dims"),
            "vec_ids": pa.array([ids[i] for i in order], pa.list_(pa.int64())), "vector": pa.array(list(vectors), pa.list_(pa.float64())), "edges": pa.array(lists, pa.list_(pa.int32())),
            "entry": pa.array(is_entry)})

    # A shard is little data and much work: its partitions are not to be merged by size.
    dealt = dealt.select("shard", "dims", "vec_ids", "vector").repartition(2 * shards, "shard", "dims")
    return dealt.groupBy("shard", "dims").applyInArrow(graph, NODE)


class _Shard:
    """The index rows of a shard and the search in them."""

    def __init__(self, parts: list[pa.RecordBatch], dims: int, p: Params):
        table = pa.Table.from_batches(parts).sort_by("node").combine_chunks()
        self.p = p
        self.vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        self.ids = table.column("vec_ids").to_pylist()
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.edges = np.full((table.num_rows + 1, p.degree), -1, np.int64)
        for i, e in enumerate(table.column("edges").to_pylist()):
            self.edges[i, : len(e)] = e
        self.entries = np.flatnonzero(table.column("entry").to_numpy(zero_copy_only=False))

    def nearest(self, own: list[int], targets: np.ndarray, k: int):
        """(query row, vec_id, distance) of the nearest found."""
        beam = min(max(self.p.search_beam, 2 * k), len(self.vectors))
        found, _, _, _ = beam_search(self.vectors, self.squares, self.edges, self.entries, targets, beam, self.p.step)
        for i, nodes in enumerate(found):
            nodes = nodes[nodes >= 0]
            gap = np.sqrt(((self.vectors[nodes] - targets[i]) ** 2).sum(axis=1))
            last = np.partition(gap, k)[k] if len(gap) > k else np.inf  # the query's own node may be one of them
            best = [(d, v) for d, node in zip(gap.tolist(), nodes.tolist(), strict=True) if d <= last for v in self.ids[node] if v != own[i]]
            for d, v in sorted(best)[:k]:
                yield i, v, d


def search(index: DataFrame, queries: DataFrame, k: int, p: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row of
    ``queries`` (vec_id, vector) in an index that was built with more than ``k`` ids, nearest first, ties to the smaller id, the
    query's own id left out. An id that occurs with several vectors is a query
    with each of them, and the nearest of all are returned."""
    shards = index.select("shard", "dims").distinct()
    parts = 2 * shards.count()
    asked = queries.withColumn("dims", F.size("vector")).join(shards, "dims")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("edges", "array<int>"), ("entry", "boolean"))]
    # A shard's nodes first, then its queries.
    rows = index.select("shard", "dims", F.lit(0).alias("kind"), "node", "vec_ids", "vector", "edges", "entry").unionByName(
        asked.select("shard", "dims", F.lit(1).alias("kind"), F.lit(0).alias("node"), F.array("vec_id").alias("vec_ids"), "vector", *empty))
    dealt = rows.repartition(max(parts, 1), "shard", "dims").sortWithinPartitions("shard", "dims", "kind", "node")

    def run(batches):
        current, parts, shard = None, [], None
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("shard", "dims", "kind")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in key], axis=0)) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if a == z:
                    continue
                piece, place = batch.slice(a, z - a), (int(key[0][a]), int(key[1][a]))
                if place != current:
                    current, parts, shard = place, [], None
                if key[2][a] == 0:
                    parts.append(piece)
                    continue
                shard = shard or _Shard(parts, current[1], p)
                for i in range(0, piece.num_rows, p.batch):
                    part = piece.slice(i, p.batch)
                    own = part.column("vec_ids").flatten().to_pylist()
                    targets = part.column("vector").flatten().to_numpy().reshape(-1, current[1])
                    found = list(shard.nearest(own, targets, k))
                    if found:
                        row, ids, gaps = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([own[r] for r in row], pa.int64()), pa.array(ids, pa.int64()), pa.array(gaps, pa.float64())],
                            ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, p: Params = Params()) -> DataFrame:
    """The ``k`` nearest of each row of ``vectors`` (vec_id, embedding) whose id
    is divisible by ``every``. Rows that take no part neither ask nor are found;
    a row that repeats id and vector counts once; vectors meet those of their own
    length only; an empty table gives no rows; other columns are ignored."""
    found = usable(vectors)
    index = stored(build(found, k + 1, p), "graph")
    return search(index, found.where(F.col("vec_id") % every == 0), k, p)
