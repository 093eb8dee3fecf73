"""Many profiles against many chunks without many copies of either on disk."""

import numpy as np

from tests.test_profiles_blocks import brute
from tests.test_search import DATA, many
from trackweave.operators import cells, search as engine
from trackweave.plans import search_queries as q
from trackweave.plans.registry import QUERIES

CHUNKS = "job_id long, chunk_index int, embedding array<double>, remote boolean, salary_max double"
ASKED = "query_id long, embedding array<double>, remote_only boolean, min_salary double"


def odd_rows():
    """Clusters, directionless vectors, unknown filters, and keys that repeat; a query without id."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(10, 6)) * 3
    rows = [
        (i // 3, i % 3, (middles[i % 10] + rng.normal(size=6) * 0.6).tolist(), i % 4 != 0 if i % 5 else None, float(i % 90) if i % 7 else None)
        for i in range(240)
    ]
    rows += [(900, 0, [0.0] * 6, True, None), (901, 0, None, True, None), (902, 0, [1.0], True, None), (903, 0, [float("inf")] * 6, True, None)]
    rows += [(7, 1, rows[22][2], *rows[22][3:])] * 20
    asked = [(i, (middles[i % 10] + rng.normal(size=6)).tolist(), i % 5 == 0, float(i) if i % 3 else None) for i in range(18)]
    asked += [(None, middles[1].tolist(), False, None), (100, [0.0] * 6, False, None), (101, middles[0].tolist(), True, 500.0)]
    return rows, asked


def small(monkeypatch):
    monkeypatch.setattr(cells, "CHUNK_BLOCK", 60)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 4)
    monkeypatch.setattr(cells, "PACK_BYTES", 8 * 6 * 25)
    monkeypatch.setattr(cells, "GROUP_ROWS", 150)


def test_chunks_are_not_copied_to_every_block_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i // 2, i % 2, rng.normal(size=6).tolist(), True, None) for i in range(400)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = [(i, rng.normal(size=6).tolist(), i % 2 == 0, None) for i in range(50)]
    queries = spark.createDataFrame(asked, ASKED)
    index = cells.build_cells(chunks, 20, 6, centers=cells.sample_centers(chunks, 20, 6))
    sent, ranked = [], cells._ranked_blocks

    def watched(chunk_rows, query_rows, key, k):
        sent.append(chunk_rows.count())
        return ranked(chunk_rows, query_rows, key, k)

    monkeypatch.setattr(cells, "_ranked_blocks", watched)
    small(monkeypatch)
    want = many(engine.search_many(chunks, queries, 5))
    assert many(cells.search_many_pruned(index, queries, 5)) == want
    assert many(cells.search_many_cells(index, queries, 5, probes=20)) == want
    assert sum(sent) <= 2 * cells.MOST_COPIES * 400  # 13 blocks of queries, which took 13 copies


def test_packs_give_the_same_rows_as_blocks(spark, monkeypatch):
    rows, asked = odd_rows()
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, ASKED)
    index = cells.build_cells(chunks, 10, 6, centers=cells.sample_centers(chunks, 10, 6))
    small(monkeypatch)
    met, packs = [], cells._ranked_packs

    def watched(placed, *rest):
        met.append(placed.count())
        return packs(placed, *rest)

    monkeypatch.setattr(cells, "_ranked_packs", watched)
    for search, k in ((cells.search_many_pruned, 4), (cells.search_many_cells, 200)):
        found = {}
        for copies in (0, 1000):
            monkeypatch.setattr(cells, "MOST_COPIES", copies)
            met.clear()
            found[copies] = sorted(map(tuple, search(index, queries, k).fillna(-9).collect()), key=str)
            assert (len(met) > 0) == (copies == 0)
        assert found[0] == found[1000] and found[0]
    monkeypatch.setattr(cells, "MOST_COPIES", 0)
    assert cells.search_many_pruned(cells.CellIndex(index.chunks.limit(0), index.centers), queries, 4).count() == 0


def test_packs_are_exact(spark, monkeypatch):
    rows, asked = odd_rows()
    rows = [r for r in rows if r[2] is not None and len(r[2]) == 6 and np.isfinite(r[2]).all()]
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, ASKED)
    index = cells.build_cells(chunks, 10, 6, centers=cells.sample_centers(chunks, 10, 6))
    small(monkeypatch)
    monkeypatch.setattr(cells, "MOST_COPIES", 0)
    got = {}
    for r in cells.search_many_pruned(index, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["job_id"], r["chunk_index"], r["similarity"]))
    want = {x: w for x, w in brute(chunks.collect(), queries.collect(), 4).items() if w}
    assert got.keys() == want.keys()
    for x, best in want.items():
        assert [b[:3] for b in got[x]] == [b[:3] for b in best], x
        assert np.allclose([b[3] or 0 for b in got[x]], [b[3] or 0 for b in best], atol=1e-8)


def test_a_given_floor_only_spares_work():
    """Candidates below what a query has elsewhere are left out, equal ones are kept; unknown floors spare nothing."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    vectors, units = rng.normal(size=(300, 5)), rng.normal(size=(7, 5))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(300)), pa.array([0] * 300, pa.int32()), pa.array(vectors.tolist())], names=["job_id", "chunk_index", "embedding"]
    )
    every = next(engine._PartitionTopK(units, None, None, 6)([batch]))
    floor = every.groupby("q")["similarity"].min().to_numpy()
    floor[3] = np.nan
    again = next(engine._PartitionTopK(units, None, None, 6, floor)([batch]))
    assert again.reset_index(drop=True).equals(every.reset_index(drop=True))
    higher = np.where(np.isnan(floor), 2.0, np.nextafter(every.groupby("q")["similarity"].max().to_numpy(), 2) + 1e-9)
    assert not list(engine._PartitionTopK(units, None, None, 6, higher)([batch]))


def test_single_precision_only_screens():
    """Scores closer than single precision tells apart are still ordered and cut by all their digits."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base, away = rng.normal(size=8), rng.normal(size=8)
    vectors = np.array([base + away * 1e-5 * rng.random() for _ in range(3000)])
    units = np.array([base, away, -base]) / np.linalg.norm([base, away, -base], axis=1, keepdims=True)
    names = ["job_id", "chunk_index", "embedding"]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(range(i, i + 500)), pa.array([0] * 500, pa.int32()), pa.array(vectors[i : i + 500].tolist())], names=names)
        for i in range(0, 3000, 500)
    ]
    found = next(engine._PartitionTopK(units, None, None, 5)(batches))
    scores = np.round(units @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T, 12)
    for query in range(3):
        best = np.lexsort((np.arange(3000), -scores[query]))[:5]
        got = found[found["q"] == query]
        assert got["job_id"].tolist() == best.tolist()
        assert np.allclose(got["similarity"], scores[query][best], rtol=0, atol=2e-12)


def test_texts_are_not_moved_with_the_vectors(spark, monkeypatch):
    kept, dropped, write, drop = {}, [], q.materialize, q.forget

    def watched(df, label):
        kept[label] = write(df, label)
        return kept[label]

    monkeypatch.setattr(q, "materialize", watched)
    monkeypatch.setattr(q, "forget", lambda *stored: (dropped.extend(stored), drop(*stored)))
    assert QUERIES["profile_matches"](spark, DATA).count() > 0
    assert "chunk_text" in kept["text-chunks"].columns and dropped == [kept["text-chunks"]]
    assert "chunk_text" not in kept["chunks"].columns + kept["in_cells"].columns
