"""Random-hyperplane hashing against the exact searches and a plain model of its buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_search import DIM, brute, make
from trackweave.operators import cells, hyperplanes as hp, search as engine
from trackweave.plans import search_queries as q
from trackweave.plans.registry import Tables


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["job_id"], round(r["similarity"], 6), r["chunk_index"]))
    return out


def test_codes_and_costs_equal_a_plain_model():
    planes = hp.sign_planes(3, 2, 4)
    assert set(np.unique(planes)) == {-1.0, 1.0}
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(20, 3))
    codes = hp.codes_of(planes, vectors)
    for vector, row, cheap in zip(vectors, codes, hp.cheapest_codes(planes, vectors, 16), strict=True):
        unit = vector / np.sqrt(vector @ vector)
        for table in range(2):
            sides = [float(p @ unit) for p in planes[table]]
            assert row[table] == sum(1 << b for b, x in enumerate(sides) if x >= 0)
            cost = lambda c: round(sum(x * x for b, x in enumerate(sides) if (c >> b & 1) != (x >= 0)), 9)  # noqa: B023, E731
            assert cheap[table].tolist() == sorted(range(16), key=lambda c: (cost(c), c))
            assert cheap[table][0] == row[table]
    with pytest.raises(ValueError):
        hp.sign_planes(3, 1, 15)


@pytest.mark.parametrize("block", [200_000, 3])
def test_all_buckets_give_the_exact_result(spark, monkeypatch, block):
    monkeypatch.setattr(cells, "CHUNK_BLOCK", block)
    monkeypatch.setattr(cells, "QUERY_BLOCK", block)
    chunks, postings, c, p = make(spark, seed=5)
    planes = hp.sign_planes(DIM, 2, 3)
    rng = np.random.default_rng(2)
    asked = {f"q{i}": ([float(x) for x in rng.integers(1, 4, DIM)], i % 2 == 0, None if i % 3 else 40.0) for i in range(9)}
    queries = spark.createDataFrame([(i, *v) for i, v in asked.items()],
                                    "query_id string, embedding array<double>, remote_only boolean, min_salary double")
    hashed = hp.hash_chunks(engine.with_filters(chunks, postings), planes)
    got = by_query(hp.search_many_hashed(hashed, planes, queries, 5, probes=8))
    directed = [row for row in c if len(row[2]) == DIM and any(row[2])]
    assert got == {i: brute(directed, p, v, 5, salary=least, remote_only=remote) for i, (v, remote, least) in asked.items()}


def test_vectors_without_direction_have_no_codes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, [1.0, 2.0]), (1, 0, [0.0, 0.0]), (2, 0, None), (3, 0, [nan, 1.0]), (4, 0, [inf, 1.0]), (5, 0, [1.0]), (6, 0, [None, 1.0])]
    chunks = spark.createDataFrame(rows, "job_id int, chunk_index int, embedding array<float>").withColumn("cell", F.lit("x"))
    planes = hp.sign_planes(2, 3, 2)
    codes = {r["job_id"]: r["codes"] for r in hp.hash_chunks(chunks, planes).collect()}
    assert len(codes) == 7 and len(codes[0]) == 3 and not any(codes[j] for j in range(1, 7))
    queries = chunks.select(F.col("job_id").alias("query_id"), "embedding")
    got = by_query(hp.search_many_hashed(hp.hash_chunks(chunks, planes), planes, queries, 3, probes=4))
    assert got == {0: [(0, 1.0, 0)]}
    none = chunks.limit(0)
    assert hp.search_many_hashed(hp.hash_chunks(none, planes), planes, queries, 3).count() == 0
    assert hp.search_many_hashed(hp.hash_chunks(chunks, planes), planes, queries.limit(0), 3).count() == 0


def test_recall_against_the_exact_search(spark):
    """Of the eight best other jobs; the given vectors hardly cluster, which is the hard case."""
    t = Tables(spark, DATA.replace("sf0.001", "sf0.01"))
    asked = t("embeddings").filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    chunks, planes = q.chunks_from(t), hp.sign_planes(64, 4, 8)
    others = lambda found: {i: {j for j, *_ in rows if j != i // 4} for i, rows in by_query(found).items()}
    exact = others(engine.search_many(chunks, asked, 9))
    got = others(hp.search_many_hashed(hp.hash_chunks(chunks, planes), planes, asked, 9, probes=64))
    recall = sum(len(got[i] & exact[i]) for i in exact) / sum(map(len, exact.values()))
    assert recall >= 0.9, recall


def test_only_buckets_with_queries_are_shuffled_and_no_pairs_joined(spark):
    chunks, *_ = make(spark)
    planes = hp.sign_planes(DIM, 2, 3)
    queries = spark.createDataFrame([("q", [1.0] * DIM)], "query_id string, embedding array<double>")
    plan = hp.search_many_hashed(hp.hash_chunks(chunks, planes), planes, queries, 3, 2)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
