"""Profiles beyond what the search on the driver takes."""

import numpy as np

from trackweave import schemas
from trackweave.operators import cells, search as engine
from trackweave.plans.matching import match_profiles, profile_queries
from tests.test_search import letters, make, many


def test_any_number_of_profiles(spark, monkeypatch):
    chunks, postings, _, _ = make(spark)
    rows = [
        (i, i, "head", "abcdef"[: i % 6 + 1] * (i % 3 + 1), None, None, 50.0 if i % 2 else None, i % 4 == 0, None)
        for i in range(1, 12)
    ]
    profiles = spark.createDataFrame(rows, schemas.PROFILES)
    want = many(engine.search_many(engine.with_filters(chunks, postings), profile_queries(profiles, letters), 4))
    monkeypatch.setattr(engine, "QUERY_ROWS", 3)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 4)
    monkeypatch.setattr(cells, "CHUNK_BLOCK", 40)
    got = match_profiles(profiles, chunks, postings, letters, 4).withColumnRenamed("user_id", "query_id")
    assert many(got) == want and len(want) == 11
    none = profiles.limit(0)
    assert match_profiles(none, chunks, postings, letters, 4).count() == 0


def brute(chunks, queries, k):
    """Every query's k best jobs, by loops."""
    out = {}
    for q in queries:
        v, best = np.array(q["embedding"], float), {}
        for c in chunks:
            if q["remote_only"] and c["remote"] is not True:
                continue
            if q["min_salary"] is not None and c["salary_max"] is not None and c["salary_max"] < q["min_salary"]:
                continue
            w = np.array(c["embedding"], float)
            size = np.linalg.norm(v) * np.linalg.norm(w)
            sim = round(float(v @ w / size), 9) if size > 0 else None
            rank = (sim is None, -(sim or 0), c["chunk_index"])
            best[c["job_id"]] = min(best.get(c["job_id"], (True, 0, 1 << 30)), rank)
        ordered = sorted(best.items(), key=lambda x: (x[1][0], x[1][1], x[0]))[:k]
        out[q["query_id"]] = [(i + 1, job, r[2], None if r[0] else -r[1]) for i, (job, r) in enumerate(ordered)]
    return out


def test_pruned_search_is_exact_and_skips_cells(spark, monkeypatch):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(12, 8)) * 4
    rows = [
        (i // 3, i % 3, (middles[i % 12] + rng.normal(size=8) * 0.5).tolist() if i % 50 else [0.0] * 8, i % 4 != 0 if i % 5 else None,
         float(i % 90) if i % 7 else None) for i in range(600)
    ]
    chunks = spark.createDataFrame(rows, "job_id long, chunk_index int, embedding array<double>, remote boolean, salary_max double")
    asked = [(i, (middles[i % 12] + rng.normal(size=8)).tolist(), i % 5 == 0, float(i) if i % 3 else None) for i in range(40)]
    asked += [(100, [0.0] * 8, False, None), (101, middles[0].tolist(), True, 89.0)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, remote_only boolean, min_salary double")
    index = cells.build_cells(chunks, 12, 8, centers=cells.sample_centers(chunks, 12, 8))
    sent, meet = [], cells._meet_in_cells

    def watched(index, routed, k):
        sent.append(routed.count())
        return meet(index, routed, k)

    monkeypatch.setattr(cells, "_meet_in_cells", watched)
    for k in (4, 500):
        sent.clear()
        got = {}
        for r in cells.search_many_pruned(index, queries, k, probes=2).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["job_id"], r["chunk_index"], None if r["similarity"] is None else round(r["similarity"], 9)))
        want = {q: w for q, w in brute(chunks.collect(), queries.collect(), k).items() if w}
        close = lambda a, b: [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] or 0 for x in a], [x[3] or 0 for x in b], atol=1e-8)
        assert got.keys() == want.keys() and all(close(got[q], want[q]) for q in got)
        assert sum(sent) < 13 * len(asked) / 2 if k == 4 else sum(sent) == 13 * len(asked)
    assert cells.search_many_pruned(index, queries.limit(0), 4).count() == 0


def test_vectors_go_to_blocks_not_to_cells(spark, monkeypatch):
    """A query that visits every cell is sent once per block of chunks; cells that span blocks are ranked whole."""
    rng = np.random.default_rng(5)
    rows = [(i // 2, i % 2, rng.normal(size=6).tolist(), True, None) for i in range(400)]
    chunks = spark.createDataFrame(rows, "job_id long, chunk_index int, embedding array<double>, remote boolean, salary_max double")
    queries = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(30)], "query_id long, embedding array<double>")
    index = cells.build_cells(chunks, 40, 6, centers=cells.sample_centers(chunks, 40, 6))
    sent, ranked = [], cells._ranked_blocks

    def watched(chunk_rows, query_rows, key, k):
        sent.append((chunk_rows.count(), query_rows.count(), query_rows.select("part", "set").distinct().count()))
        return ranked(chunk_rows, query_rows, key, k)

    monkeypatch.setattr(cells, "_ranked_blocks", watched)
    want = many(engine.search_many(chunks, queries, 5))
    assert many(cells.search_many_cells(index, queries, 5, probes=40)) == want
    assert sent == [(400, 30, 1)]  # not 40 cells x 30 queries
    monkeypatch.setattr(cells, "CHUNK_BLOCK", 150)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 10)
    assert many(cells.search_many_cells(index, queries, 5, probes=40)) == want
    assert sent[1:] == [(1200, 90, 9)]
