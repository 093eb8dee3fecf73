"""Whitening against whole-number loops and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from trackweave.llm import queries, whitening

NAN, INF = float("nan"), float("inf")


def by_hand(vectors):
    """Covariance and deviations in whole numbers of any size."""
    x = [[math.floor(64.0 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    z = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in z) / n**3 for j in range(d)] for i in range(d)])
    return cov, [sum(v * v for v in r) for r in z], np.array(z, dtype=float) / n


def check(rows, vectors, k):
    cov, far, z = by_hand(vectors)
    values, _ = np.linalg.eigh(cov)
    values = values[::-1]
    assert len(rows) == len(vectors) * k
    white = np.full((len(vectors), k), np.nan)
    for r in rows:
        assert r.n == len(vectors) and int(r.deviation_text) == far[r.vec_id]
        assert r.deviation == (far[r.vec_id] if far[r.vec_id] < 1 << 63 else None)
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-4 * r.explained
        assert r.identity_error <= 1e-4
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(white.T @ white / len(vectors), np.eye(k), atol=1e-6)
    # The components are eigenvectors: projecting back on the centred rows gives V's columns.
    vectors_of = z.T @ white / len(vectors) / np.sqrt(values[:k])
    assert np.allclose(np.linalg.norm(vectors_of, axis=0), 1, atol=1e-6)
    assert np.allclose(cov @ vectors_of, vectors_of * values[:k], atol=1e-6 * values[0])


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_equals_whole_number_loops(spark, scale):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * scale).tolist()
    table = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>").repartition(4)
    check(whitening.whitened(table, 4).collect(), data, 4)


def test_query(spark):
    given = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    rows = queries.QUERIES["op13_embedding_whitening"](spark, DATA).withColumn("deviation_text", F.col("deviation").cast("string"))
    assert [r.vec_id for r in given] == list(range(len(given)))
    check(rows.collect(), [r.embedding for r in given], 32)


def test_awkward_rows(spark):
    rows = [
        (1, [1.0, 2.0]), (1, [3.0, -1.0]), (None, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [NAN, 1.0]), (7, [INF, 0.0]), (8, []),
        (9, [5.0]), (10, [1e300, 2.0]), (11, [1.0, 1.0, 1.0]), (12, [2.0, 2.0, 1.0]), (13, [-1e300, 0.5]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit("x"), "component": F.lit(0)})
    got = whitening.whitened(table).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n) for r in got) == sorted(
        [(v is None, v or 0, c, 5) for v in (1, 1, None, 10, 13) for c in (1, 2)] + [(False, 9, 1, 1)]
        + [(False, v, c, 2) for v in (11, 12) for c in (1, 2, 3)]
    )
    # One row, and directions without variance: nothing to divide by.
    assert [(r.whitened, r.explained) for r in got if r.vec_id == 9] == [(None, None)]
    flat = [r for r in got if r.vec_id in (11, 12)]
    assert {abs(round(r.whitened, 9)) for r in flat if r.component == 1} == {1.0}
    assert all(r.whitened is None and r.explained == pytest.approx(0, abs=1e-12) for r in flat if r.component > 1)
    assert all(r.deviation is None and len(r.deviation_text) > 30 for r in got if r.vec_id == 10)
    assert all(r.identity_error < 1e-4 for r in got)
    assert whitening.whitened(table.limit(0)).count() == 0
    assert whitening.whitened(table.filter("vec_id = 4")).count() == 0


def test_same_sums_in_any_order(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    one, other = whitening.fit(table), whitening.fit(table.repartition(7))
    assert all(np.array_equal(one[d].vectors, other[d].vectors) and one[d].total == other[d].total for d in one)
