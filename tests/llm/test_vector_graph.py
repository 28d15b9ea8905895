"""Graph searches against brute force."""

import numpy as np
import pytest

from tidemark.llm import vector_graph

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def brute(rows, queries, k):
    """Rows and queries are (id, vector or None)."""

    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def unique(pairs):
        out = {}
        for i, v in pairs:
            if i is not None and fine(v):
                out[i] = min(out.get(i, v), v)
        return out

    every, out = unique(rows), []
    for q, v in unique(queries).items():
        v64 = np.array(v, np.float32).astype(np.float64)
        scored = sorted((-float((np.array(x, np.float32).astype(np.float64) * v64).sum()), i) for i, x in every.items() if i != q and len(x) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)


def recall(found, want):
    best = {}
    for q, _, i, _ in want:
        best.setdefault(q, set()).add(i)
    got = {q: {r.vec_id for r in found if r.query_id == q} for q in best}
    return np.mean([len(best[q] & got[q]) / len(best[q]) for q in best])


@pytest.mark.parametrize("kind", ["sphere", "lengths", "clusters"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 700)
    monkeypatch.setattr(vector_graph, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2_000, 24))
    if kind == "lengths":
        x *= rng.lognormal(0, 0.6, size=(2_000, 1))
    if kind == "clusters":
        x = x[:5][rng.integers(0, 5, 2_000)] + 0.01 * x
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    asked = rows[::20]
    want = brute(rows, asked, 20)
    found = vector_graph.nearest(table(spark, rows), table(spark, asked), 20).collect()
    assert len(found) == len(want) and recall(found, want) >= 0.95
    score = {(q, i): s for q, i, s in ((a, b, float((x[a].astype(np.float32).astype(float) * x[b].astype(np.float32)).sum())) for a, _ in asked for b in range(2_000))}
    assert all(abs(r.score - score[r.query_id, r.vec_id]) < 1e-12 for r in found)
    by = sorted(found, key=lambda r: (r.query_id, r["rank"]))
    assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) and b["rank"] == a["rank"] + 1 for a, b in zip(by, by[1:]) if a.query_id == b.query_id)


def test_odd_rows_are_exact(spark):
    """Few rows are found without a miss: copies, ties, repeated ids, other lengths and rows that take no part."""
    rows = [(i, [float(i % 7), 1.0, float(-i % 3)]) for i in range(60)]
    rows += [(100 + i, [2.0, 1.0, 2.0]) for i in range(40)]
    rows += [(None, [1.0, 1.0, 1.0]), (200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 2.0]), (280, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 0.0, 0.0])]
    rows += [(20, [9.0, 9.0, 9.0]), (20, [0.5, 0.5, 0.5]), (40, rows[40][1]), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (322, [-2.0, 1.0]), (340, [3.0]), (360, [1e30, 1e30, 1e30])]
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(5000, [1.0, 0.0, 0.0])]
    found = vector_graph.nearest(table(spark, rows), table(spark, asked), 20).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows, asked, 20))


def test_empty(spark):
    none, some = table(spark, []), table(spark, [(0, [1.0, 2.0])])
    assert vector_graph.nearest(none, none, 20).collect() == [] and vector_graph.nearest(some, some, 20).collect() == []
    assert vector_graph.nearest(none, some, 20).collect() == []


def test_search_goes_on_where_a_graph_is_in_parts():
    x = np.eye(6, dtype=np.float32)
    near = np.array([[1, -1], [0, -1], [3, -1], [2, -1], [5, -1], [4, -1]], np.int32)
    nodes, scores = vector_graph.Graph(x, [6], [near]).search(x[:2] + 0.5 * x[4], 6, 6)
    assert sorted(nodes[0]) == list(range(6)) and nodes[0][0] == 0 and nodes[0][1] == 4 and scores[0][0] == 1.0
