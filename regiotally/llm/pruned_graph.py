"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard of the vectors.

Vectors are dealt to shards by their hash. In a shard, greedy searches from the vector nearest to the mean propose the
neighbours of each vector; pruning keeps the nearest one, drops all that it is clearly nearer to than the vector is
(``alpha`` times), and goes on with the rest, so the few edges that stay lead into different directions. Edges are
entered backwards too and pruned again where a vector has too many. A query walks every shard's graph with a beam; the
nodes of the beam are measured anew in double precision, and one window merges the shards' answers.

Searches of a whole batch advance in step, so that all distances of a step are one array operation. Equal vectors are
one node with the smallest ids, more of which no answer can hold; a vector that a third of all rows share is cut down
before it is shuffled. The index is written once to the shared folder: every row of it is found again from its shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from regiotally.llm.rows import written


@dataclass(frozen=True)
class Graph:
    """Edges a node keeps, and up to how many it may gather before it is pruned again; beams of building and searching,
    the relaxation, and the bounds of what one task holds."""

    degree: int = 32
    gathered: int = 48
    beam: int = 64
    search_beam: int = 128
    alpha: float = 1.2
    shard_rows: int = 10_000
    query_block: int = 4_096
    batch: int = 500


# ---- one shard -------------------------------------------------------------------------------------------------------


def squared(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of queries (b, d) to their own points (b, m, d)."""
    gap = points - queries[:, None, :]
    return np.einsum("bmd,bmd->bm", gap, gap)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes that each query meets, nearest first, and the nodes that it walked over.

    All queries take a step at once: each opens the nearest node of its beam that is still closed, until none is.
    Places without a node hold -1 at an infinite distance.
    """
    b = len(queries)
    ids, dist, waiting = np.full((b, beam), -1, np.int32), np.full((b, beam), np.inf, np.float32), np.zeros((b, beam), bool)
    ids[:, 0], dist[:, 0], waiting[:, 0] = entry, squared(points[None, [entry]].repeat(b, 0), queries)[:, 0], True
    walked, lengths, active = [], [], np.arange(b)
    while True:
        first = waiting[active].argmax(axis=1)
        has = waiting[active, first]
        active, first = active[has], first[has]
        if not len(active):
            break
        node, seen, far = ids[active, first], np.full(b, -1, np.int32), np.full(b, np.inf, np.float32)
        waiting[active, first] = False
        seen[active], far[active] = node, dist[active, first]
        walked.append(seen)
        lengths.append(far)
        near, own = edges[node], ids[active]
        gaps = squared(points[near], queries[active])
        gaps[(near < 0) | (near[:, :, None] == own[:, None, :]).any(axis=2) | (gaps > dist[active, -1:])] = np.inf
        all_gaps = np.concatenate([dist[active], gaps], axis=1)
        order = all_gaps.argsort(axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_gaps, order, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([own, np.where(np.isinf(gaps), -1, near)], axis=1), order, axis=1)
        waiting[active] = np.take_along_axis(np.concatenate([waiting[active], ~np.isinf(gaps)], axis=1), order, axis=1)
    return ids, dist, np.stack(walked, axis=1), np.stack(lengths, axis=1)


def robust_prune(points: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` edges for each of ``nodes`` out of its ``found`` nodes (-1: none; repeats count once)."""
    kept = np.full((len(nodes), degree), -1, np.int32)
    step = max(1, 4_000_000 // (found.shape[1] * max(found.shape[1], points.shape[1])))
    for at in range(0, len(nodes), step):
        own = nodes[at : at + step]
        ids = np.sort(found[at : at + step], axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        ids[ids == own[:, None]] = -1
        away = points[ids] - points[own][:, None, :]  # seen from the node, so that near copies keep their digits
        dist = np.einsum("bmd,bmd->bm", away, away)
        dist[ids < 0] = np.inf
        order = dist.argsort(axis=1, kind="stable")
        ids, dist, away = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(away, order[:, :, None], 1)
        inner = away @ away.transpose(0, 2, 1)
        alive = ids >= 0
        size = np.where(alive, dist, 0)
        rows = np.arange(len(ids))
        for k in range(degree):
            pick = alive.argmax(axis=1)
            on = alive[rows, pick]
            if not on.any():
                break
            kept[at : at + step][on, k] = ids[rows, pick][on]
            between = size + size[rows, pick][:, None] - 2 * inner[rows, pick]
            alive &= alpha * alpha * between > size
            alive[rows, pick] = False
    return kept


def _enter_backwards(points: np.ndarray, edges: np.ndarray, nodes: np.ndarray, how: Graph) -> None:
    """For every edge of ``nodes`` the reverse one; a node that then has more than ``gathered`` is pruned."""
    width = edges.shape[1]
    to, frm = edges[nodes].ravel(), np.repeat(nodes, width)
    frm, to = frm[to >= 0], to[to >= 0]
    new = ~(edges[to] == frm[:, None]).any(axis=1)
    order = np.argsort(to[new], kind="stable")
    frm, to = frm[new][order], to[new][order]
    targets, starts, counts = np.unique(to, return_index=True, return_counts=True)
    by_count = np.argsort(counts, kind="stable")
    for part in np.array_split(by_count, max(1, math.ceil(len(by_count) / 256))):  # nodes of about as many new edges together
        if len(part):
            wide = np.full((len(part), width + int(counts[part].max())), -1, np.int32)
            wide[:, :width] = edges[targets[part]]
            column = np.arange(wide.shape[1] - width)[None, :]
            valid = column < counts[part][:, None]
            wide[:, width:][valid] = frm[(starts[part][:, None] + column)[valid]]
            wide = -np.sort(-wide, axis=1)  # places without a node come last
            full = wide[:, width] >= 0
            edges[targets[part]] = wide[:, :width]
            if full.any():
                _set(edges, targets[part][full], robust_prune(points, targets[part][full], wide[full], how.degree, how.alpha))


def _set(edges: np.ndarray, nodes: np.ndarray, kept: np.ndarray) -> None:
    edges[nodes, : kept.shape[1]] = kept
    edges[nodes, kept.shape[1] :] = -1


def reached(edges: np.ndarray, entry: int) -> np.ndarray:
    """Which nodes a walk from ``entry`` can meet."""
    seen, front = np.zeros(len(edges), bool), np.array([entry])
    while len(front):
        seen[front] = True
        front = np.unique(edges[front])
        front = front[(front >= 0)]
        front = front[~seen[front]]
    return seen


def _tie_in(points: np.ndarray, edges: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """Edges that make every node reachable, beyond the degree where needed: one row must never be lost to searches."""
    while not (seen := reached(edges, entry)).all():
        lost = np.flatnonzero(~seen)[:1_000]
        ids, dist, _, _ = beam_search(points, edges, entry, points[lost], beam)
        order = np.argsort(dist[:, 0], kind="stable")
        hosts, first = np.unique(ids[order, 0], return_index=True)  # one new edge a host and round
        free = (edges[hosts] < 0).any(axis=1)
        if not free.all():
            edges = np.concatenate([edges, np.full((len(edges), 1), -1, np.int32)], axis=1)
        edges[hosts, (edges[hosts] < 0).argmax(axis=1)] = lost[order][first]
    return edges


def build_graph(vectors: np.ndarray, how: Graph = Graph()) -> tuple[np.ndarray, int]:
    """Edges (n, gathered or a little more; -1: none) and the entry of the graph over ``vectors``.

    Batches that double in size enter the nodes in a fixed random order; a second round proposes neighbours for each
    node again, now that all are there. Every node can be reached from the entry.
    """
    points = _scaled(vectors)
    n = len(points)
    edges = np.full((n, max(how.gathered, how.degree)), -1, np.int32)
    entry = int(squared(points[None], points.mean(axis=0, dtype=np.float64).astype(np.float32)[None])[0].argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    for again in (False, True):
        at = 0 if again else 1
        while at < n:
            size = how.batch if again else min(at, how.batch)
            nodes = order[at : at + size]
            at += size
            _, _, walked, _ = beam_search(points, edges, entry, points[nodes], how.beam)
            found = np.concatenate([walked, edges[nodes]], axis=1)
            _set(edges, nodes, robust_prune(points, nodes, found, how.degree, how.alpha))
            _enter_backwards(points, edges, nodes, how)
    return _tie_in(points, edges, entry, how.beam), entry


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Single precision for walking, scaled so that no square overflows; answers are measured on the originals."""
    top = np.abs(vectors).max(initial=0.0)
    return (vectors / (top or 1.0)).astype(np.float32)


def exact_distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of the components."""
    gap = vectors - query[None, :]
    return np.sqrt(np.add.accumulate(gap * gap, axis=1)[:, -1])


def answers(vectors: np.ndarray, held: list[list[int | None]], edges: np.ndarray, entry: int, ids: list, queries: np.ndarray, k: int, how: Graph) -> list[tuple[int, int | None, float]]:
    """``(number of the query, vec_id, distance)`` of the ``k`` nearest rows that each query's beam holds, itself left out."""
    top = max(np.abs(vectors).max(initial=0.0), np.abs(queries).max(initial=0.0)) or 1.0
    points, asked = (vectors / top).astype(np.float32), (queries / top).astype(np.float32)
    out = []
    for at in range(0, len(queries), how.batch):
        nodes, _, _, _ = beam_search(points, edges, entry, asked[at : at + how.batch], max(how.search_beam, 2 * k))
        for q in range(len(nodes)):
            near, query = nodes[q][nodes[q] >= 0], queries[at + q]
            gaps = exact_distances(vectors[near], query)
            rows = []
            for place in np.argsort(gaps, kind="stable").tolist():
                if len(rows) >= k and gaps[place] > rows[-1][0]:
                    break
                own = held[near[place]]
                if gaps[place] == 0 and ids[at + q] in own and (vectors[near[place]] == query).all():
                    own = own.copy()
                    own.remove(ids[at + q])
                rows += [(float(gaps[place]), i is None, i or 0, i) for i in own]
            out += [(at + q, i, gap) for gap, _, _, i in sorted(rows)[:k]]
    return out


# ---- all shards ------------------------------------------------------------------------------------------------------


def usable(vector: str | Column) -> Column:
    """Neither null, empty or zero, nor with a null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vector_rows(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, vector, dim`` of the usable rows; a component of minus zero becomes zero."""
    kind = table.schema[vector_column].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>" if single else "array<double>").alias("vector"))
    plain = F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast("float" if single else "double")).otherwise(x))
    return rows.filter(usable("vector")).select("id", plain.alias("vector"), F.size("vector").alias("dim"))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector with its ``keep`` smallest ids, nulls last. Tasks cut down hot vectors before the shuffle."""
    smallest = F.row_number().over(W.partitionBy("dim", "vector").orderBy(F.col("id").asc_nulls_last()))
    few = rows.withColumn("_n", smallest).filter(F.col("_n") <= keep)
    held = F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))), lambda s: s["id"])
    return few.groupBy("dim", "vector").agg(held.alias("ids"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def indexed(nodes: DataFrame, how: Graph = Graph()) -> tuple[DataFrame, int]:
    """The graphs, ``dim, shard, place, entry, vector, ids, edges``, and the number of shards. ``nodes`` as of ``nodes_of``.

    A shard holds about ``shard_rows`` vectors of one length, whatever the data, and is one task's work.
    """
    kept = written(nodes, "vectors")
    shards = max(1, math.ceil(kept.count() / how.shard_rows))
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).repartition(3 * shards, "dim", "shard")
    vector = kept.schema["vector"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        edges, entry = build_graph(_matrix(table.column("vector")), how)
        offsets = np.arange(len(edges) + 1, dtype=np.int32) * edges.shape[1]
        return pa.table(
            {
                "dim": table.column("dim"),
                "shard": table.column("shard"),
                "place": pa.array(np.arange(len(edges), dtype=np.int32)),
                "entry": pa.array(np.arange(len(edges)) == entry),
                "vector": table.column("vector"),
                "ids": table.column("ids"),
                "edges": pa.ListArray.from_arrays(pa.array(offsets), pa.array(edges.ravel())),
            }
        )

    made = dealt.groupBy("dim", "shard").applyInArrow(build, f"dim int, shard int, place int, entry boolean, vector {vector}, ids array<long>, edges array<int>")
    return written(made, "graph"), shards


def searched(index: DataFrame, shards: int, queries: DataFrame, k: int = 10, how: Graph = Graph()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for every row of ``queries`` (``id, vector, dim``).

    Queries are the given set, in blocks: every block meets every shard once, and a task holds one shard and one block.
    A row of the index with the query's own id and vector is left out once. Equal query rows are answered alike.
    """
    asked = queries.groupBy("id", "vector", "dim").agg(F.count(F.lit(1)).alias("copies"))
    asked = written(asked.withColumn("q", F.xxhash64("id", "vector")), "queries")
    blocks = max(1, math.ceil(asked.count() / how.query_block))
    keys, parts = ["dim", "shard", "block"], 3 * shards * blocks
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, *keys)
    right = asked.withColumns({"block": F.pmod("q", F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))}).repartition(parts, *keys)
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("copies", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(graph: pa.Table, block: pa.Table) -> pa.Table:
        if not graph.num_rows or not block.num_rows:
            return schema.empty_table()
        graph = graph.sort_by("place")
        lists = graph.column("edges").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        edges = lists.flatten().to_numpy(zero_copy_only=False).reshape(graph.num_rows, -1)
        entry = int(np.flatnonzero(graph.column("entry").to_numpy())[0])
        ids = block.column("id").to_pylist()
        found = answers(_matrix(graph.column("vector")), graph.column("ids").to_pylist(), edges, entry, ids, _matrix(block.column("vector")), k, how)
        at = pa.array([f[0] for f in found], pa.int64())
        columns = [block.column(c).take(at) for c in ("id", "q", "copies")]
        return pa.Table.from_arrays([*columns, pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], schema=schema)

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, q long, copies long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy("score", F.col("vec_id").asc_nulls_last()))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def neighbours(table: DataFrame, k: int = 10, every: int = 100, how: Graph = Graph(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``: ``query_id, rank, vec_id, score``.

    Nearness is the Euclidean distance, ties go to the smaller id, rows without an id come last and ask nothing. A row is
    no candidate of its own; another row of the same id is, also one of the same vector. Vectors that are null, empty,
    zero or hold a null or non-finite component take no part; those of another length are no candidates. Other columns
    are not read. An empty table gives no rows.
    """
    rows = vector_rows(table, id_column, vector_column)
    index, shards = indexed(nodes_of(rows, k + 1), how)
    return searched(index, shards, rows.filter(F.col("id") % every == 0), k, how)
