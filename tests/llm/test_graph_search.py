"""Graph search against brute force."""

import numpy as np
import pytest
from pyspark.sql import Row

from trackweave.llm import graph_search as g, queries
from tests.conftest import DATA


def brute(rows, every, k):
    """(query, [(score, id)]) by full scan; rows are (id, vector)."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v
            and np.isfinite(np.array(v, np.float64)).all() and np.any(np.array(v, np.float64))]
    out = {}
    for i, v in good:
        if i % every == 0:
            found = sorted((-float(np.dot(v, w)), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = found[:k]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, got = brute(rows, 20, 20), by_query(queries.QUERIES["op3_pruned_graph_search"](spark, DATA).collect())
    assert set(want) == set(got)
    hit = total = 0
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 and i != q for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
        total += 20
    assert hit / total >= 0.95


@pytest.mark.parametrize("shard_rows", [50, 10_000])
def test_awkward(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(120)]  # a hot vector
    rows += [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 0.0, 0.0]), (2060, [float("nan"), 1.0, 1.0, 1.0]),
             (2080, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (4000, [50.0, 0.0, 0.0, 0.0])]
    rows += [rows[0]]
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, node=1) for i, v in rows], "vec_id long, embedding array<float>, node int")
    good = df.filter(g.usable(df.embedding) & df.vec_id.isNotNull())
    graphs = g.build_graphs(good, 20, shard_rows)
    got = by_query(g.search_graphs(graphs, good.filter("vec_id % 20 = 0"), 20).collect())
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in dict(rows).items()]
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    for q in want:
        assert [round(s, 9) for _, _, s in got[q]] == [round(-s, 9) for s, _ in want[q]]
        if q >= 1000 and q < 2000:
            assert [i for _, i, _ in got[q]] == [i for _, i in want[q]]  # ties to smaller ids
    assert got[3000] == [(1, 3001, 4.0)]
    assert g.nearest(df.limit(0), 20, 20).count() == 0


def test_every_node_is_reached():
    points = np.concatenate([np.random.default_rng(i).normal(i * 40, 1, (300, 6)) for i in range(4)])
    graph = g.Graph(g.lifted(points, np.sqrt((points ** 2).sum(axis=1)).max())).build()
    seen, front = set(graph.entries.tolist()), graph.entries.tolist()
    while front:
        front = [int(x) for n in front for x in graph.edges[n] if x >= 0 and int(x) not in seen]
        seen |= set(front)
    assert len(seen) == len(points)


@pytest.mark.parametrize("far", [False, True])
def test_double_vectors_stay_double(spark, far):
    """Scores of vectors that float cannot hold: large ones beside small ones, and products beyond a double."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * (1e140 if i % 3 else 1e-3)).tolist()) for i in range(40 if far else 300)]
    rows += [(2000, [1e300] * 6), (2001, [-1e300, 1e300] * 3)] if far else []
    got = by_query(g.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=10).collect())
    vectors, hit = {i: np.array(v) for i, v in rows}, 0
    assert set(got) == {i for i in vectors if i % 20 == 0}
    with np.errstate(over="ignore", invalid="ignore"):
        for q, found in got.items():
            scores = {i: float(np.dot(vectors[q], v)) for i, v in vectors.items() if i != q}
            ranked = sorted((-(s if s == s else -np.inf), i) for i, s in scores.items())[:10]
            hit += len({i for _, i in ranked} & {i for _, i, _ in found})
            for _, i, s in found:
                assert s == pytest.approx(scores[i], rel=1e-9) or (scores[i] != scores[i] and s == -np.inf)
    assert far or hit >= 0.9 * 10 * len(got)  # beside 1e300, what is left is nothing in single precision


def test_differences_below_float(spark):
    rows = [(1001 + i, [1.0 + i * 1e-12, 1.0]) for i in range(5)] + [(20, [1e3, 0.0])]
    got = by_query(g.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=5).collect())
    assert [i for _, i, _ in got[20]] == [1005, 1004, 1003, 1002, 1001]
