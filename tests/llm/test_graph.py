import numpy as np
import pytest
from pyspark.sql import functions as F

from regiotally.llm import pruned_graph as pg


def exact(rows, k=10, every=100):
    """The nearest rows of every query by a full scan; ``rows`` are (id, list of numbers)."""
    fit = [(n, i, np.array(v, dtype=np.float64)) for n, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, v in fit:
        if i is not None and i % every == 0:
            near = sorted((float(np.sqrt(np.add.accumulate((w - v) ** 2)[-1])), j is None, j or 0, m) for m, j, w in fit if m != n and len(w) == len(v))
            out += [(i, rank + 1, None if none else j, gap) for rank, (gap, none, j, _) in enumerate(near[:k])]
    return sorted(out, key=str)


def answered(spark, rows, kind="float", **how):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"ids": F.lit(1), "edges": F.lit("x"), "q": F.lit(2), "shard": F.lit(9)})
    return sorted((tuple(r) for r in pg.neighbours(table, how=pg.Graph(**how)).collect()), key=str)


def clustered(n, dim=16, seed=1):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(12, dim))
    return (centres[pick.integers(0, 12, n)] + 0.3 * pick.normal(size=(n, dim))).astype(np.float32)


def test_small_tables_with_everything_are_exact(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(150, 5))]
    rows += [(200, rows[7][1])] * 2 + [(i, rows[7][1]) for i in range(300, 330)]  # copies, also of a query
    rows += [(None, rows[0][1]), (None, rows[0][1]), (400, None), (401, []), (500, [0.0] * 5), (600, [1.0, None, 1.0, 1.0, 1.0])]
    rows += [(700, [float("nan")] * 5), (800, [float("inf")] * 5), (900, [1.0, 2.0]), (901, [1.0, 3.0]), (1000, [-0.0, 1.0]), (1001, [0.0, 1.0]), (100, rows[3][1])]
    assert answered(spark, rows) == exact([(i, v) for i, v in rows])
    assert answered(spark, rows, shard_rows=30, query_block=2) == exact([(i, v) for i, v in rows])


def test_doubles_keep_their_digits(spark):
    rows = [(i, [1e150 + i * 1e140, 3.0, float(i % 3)]) for i in range(40)] + [(100, [1e150, 3.0, 1e-9])]
    assert answered(spark, rows, "double") == exact(rows)


def test_empty_table(spark):
    assert answered(spark, []) == []
    assert answered(spark, [(100, [1.0, 2.0])]) == []


def test_recall_over_shards(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(4_000))]
    got, want = answered(spark, rows, shard_rows=1_500), exact(rows)
    assert len(got) == len(want) and len({r[0] for r in got}) == 40
    assert len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) >= 0.95 * len(want)
    held = {(r[0], r[2]): r[3] for r in want}
    assert all(held[r[0], r[2]] == r[3] for r in got if (r[0], r[2]) in held)


def test_pruning_keeps_what_the_rule_keeps():
    pick = np.random.default_rng(4)
    points = pick.normal(size=(60, 6)).astype(np.float32)
    found = pick.integers(-1, 60, size=(20, 40)).astype(np.int32)
    got = pg.robust_prune(points, np.arange(20), found, 8, 1.2)
    for p in range(20):
        left = sorted(set(found[p].tolist()) - {-1, p}, key=lambda c: ((points[c] - points[p]) ** 2).sum())
        kept = []
        while left and len(kept) < 8:
            best = left.pop(0)
            kept.append(best)
            left = [c for c in left if 1.2 * np.linalg.norm(points[best] - points[c]) > np.linalg.norm(points[p] - points[c])]
        assert [c for c in got[p].tolist() if c >= 0] == kept


@pytest.mark.parametrize("n", [1, 2, 3, 700])
def test_every_node_can_be_reached(n):
    vectors = np.concatenate([clustered(n, 4), clustered(n, 4, 2) + 1000]).astype(np.float64)  # two far islands
    edges, entry = pg.build_graph(vectors, pg.Graph(degree=4, gathered=5, beam=8))
    assert pg.reached(edges, entry).all()
    for node, own in enumerate(edges):
        held = own[own >= 0].tolist()
        assert len(held) == len(set(held)) and node not in held


def test_lost_nodes_are_tied_in():
    points = clustered(50, 3)
    edges = np.full((50, 2), -1, np.int32)
    edges[0] = [1, 2]
    tied = pg._tie_in(points, edges, 0, 8)
    assert pg.reached(tied, 0).all()


def test_whole_beam_is_exact_on_a_small_graph():
    vectors = clustered(90, 4).astype(np.float64)
    edges, entry = pg.build_graph(vectors, pg.Graph())
    got = pg.answers(vectors, [[i] for i in range(90)], edges, entry, [-1], vectors[:1] + 0.01, 10, pg.Graph())
    order = np.argsort(pg.exact_distances(vectors, vectors[0] + 0.01), kind="stable")[:10]
    assert [r[1] for r in got] == order.tolist()
