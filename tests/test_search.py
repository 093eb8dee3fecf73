import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import cells, search as engine
from tests.conftest import DATA
from trackweave import schemas
from trackweave.functions.models import hashing_embedder
from trackweave.plans import search_queries as q
from trackweave.plans.matching import draft_materials, explain_matches, match_profiles, profile_queries
from trackweave.plans.registry import QUERIES, Tables

DIM = 6


def make(spark, jobs=60, seed=1, copies=0.0):
    """Chunks and postings with ties, zero vectors, wrong lengths and NULL filter values."""
    rng = np.random.default_rng(seed)
    chunk_rows, posting_rows = [], []
    for j in range(jobs):
        for c in range(int(rng.integers(1, 5))):
            v = np.ones(DIM) if rng.random() < copies else rng.integers(-3, 4, DIM).astype(float)
            chunk_rows.append((f"j{j:03d}", c, [float(x) for x in v]))
        if j % 10 != 9:  # every tenth job has chunks but no posting
            remote = [True, False, None][int(rng.integers(3))]
            salary = None if rng.random() < 0.3 else float(rng.integers(1, 10) * 10)
            posting_rows.append((f"j{j:03d}", f"t{j}", "co", "loc", remote, 1.0, salary, "u", ["x"]))
    chunk_rows += [("j000", 50, [0.0] * DIM), ("j001", 50, [1.0]), ("z", 0, [0.0] * DIM)]
    posting_rows.append(("z", "zero", "co", "loc", True, None, None, "u", []))
    chunks = spark.createDataFrame(chunk_rows, "job_id string, chunk_index int, embedding array<float>").repartition(5)
    postings = spark.createDataFrame(
        posting_rows,
        "job_id string, title string, company string, location string, remote boolean, "
        "salary_min double, salary_max double, url string, tags array<string>",
    )
    return chunks, postings, chunk_rows, posting_rows


def brute(chunk_rows, posting_rows, query, k, remote=None, salary=None, by_key=False, remote_only=False):
    q = np.asarray(query, float)
    allowed = {
        p[0] for p in posting_rows
        if (remote is None or p[4] is remote) and (salary is None or p[6] is None or p[6] >= salary)
        and (not remote_only or p[4] is True)
    }
    best = {}
    for job, index, v in chunk_rows:
        if job not in allowed:
            continue
        v = np.asarray(v)
        score = None
        if len(v) == len(q) and v @ v > 0 and q @ q > 0:
            score = float(v @ q / np.sqrt((v @ v) * (q @ q)))
        key = (-2.0 if score is None else round(score, 9), -index)
        if job not in best or key > best[job][0]:
            best[job] = (key, score, index)
    rows = [(job, None if s is None else round(s, 6), i) for job, (_, s, i) in best.items()]
    order = lambda r: (-(r[1] if r[1] is not None else -2), r[0])
    if by_key:
        rows = sorted(rows)[:k]
    return sorted(rows, key=order)[:k]


def shown(df):
    return [(r["job_id"], None if r["similarity"] is None else round(r["similarity"], 6)) for r in df.collect()]


@pytest.mark.parametrize("kind", ["arrow", "native"])
@pytest.mark.parametrize("remote, salary", [(None, None), (True, None), (False, 50.0), (None, 70.0)])
def test_search_equals_brute_force(spark, kind, remote, salary):
    chunks, postings, c, p = make(spark)
    query = [1.0, 2.0, -1.0, 0.5, 0.0, 3.0]
    for mode in ("similarity", "key"):
        got = engine.search(chunks, postings, query, 8, remote, salary, mode, kind)
        want = brute(c, p, query, 8, remote, salary, by_key=mode == "key")
        assert shown(got) == [w[:2] for w in want]
    assert got.columns == [*engine.SHOWN, "similarity"]


def test_ranking_first_never_scores_below_key_order(spark):
    chunks, postings, _, _ = make(spark, seed=3)
    query = [1.0] * DIM
    ranked = [s for _, s in shown(engine.search(chunks, postings, query, 8))]
    by_key = [s for _, s in shown(engine.search(chunks, postings, query, 8, limit_order="key"))]
    assert all(a >= b for a, b in zip(ranked, by_key))


def test_undefined_scores_come_last_and_stay(spark):
    chunks, postings, c, p = make(spark, jobs=4)
    got = shown(engine.search(chunks, postings, [1.0] * DIM, 50))
    assert got == [w[:2] for w in brute(c, p, [1.0] * DIM, 50)] and got[-1] == ("z", None)


def many(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        s = r["similarity"]
        out.setdefault(r["query_id"], []).append((r["job_id"], None if s is None else round(s, 6), r["chunk_index"]))
    return out


@pytest.mark.parametrize("copies", [0.0, 0.4])
@pytest.mark.parametrize("small", [False, True])
def test_many_queries_equal_brute_force(spark, monkeypatch, copies, small):
    chunks, postings, c, p = make(spark, seed=5, copies=copies)
    rng = np.random.default_rng(2)
    vectors = {f"q{i}": [float(x) for x in rng.integers(-2, 3, DIM)] for i in range(12)}
    vectors["q0"], vectors["same"] = [1.0] * DIM, [0.0] * DIM
    if small:  # few rows scored at once
        monkeypatch.setattr(engine, "SCORE_CELLS", 400)
        monkeypatch.setattr(engine, "CROWD", 0 if copies else 1)
    queries = spark.createDataFrame(list(vectors.items()), "query_id string, embedding array<double>")
    got = many(engine.search_many(engine.with_filters(chunks, postings), queries, 5))
    assert got == {q: brute(c, p, v, 5) for q, v in vectors.items()}

    filters = {q: (i % 2 == 0, None if i % 3 else 40.0) for i, q in enumerate(vectors)}
    own = spark.createDataFrame([(q, v, *filters[q]) for q, v in vectors.items()],
                                "query_id string, embedding array<double>, remote_only boolean, min_salary double")
    got = many(engine.search_many(engine.with_filters(chunks, postings), own, 5))
    assert got == {q: brute(c, p, v, 5, salary=filters[q][1], remote_only=filters[q][0]) for q, v in vectors.items()}


def test_many_without_postings(spark):
    chunks, _, c, _ = make(spark)
    queries = spark.createDataFrame([(1, [1.0] * DIM)], "query_id bigint, embedding array<double>")
    everyone = [(j, "", "", "", None, None, None, "", []) for j in {row[0] for row in c}]
    assert many(engine.search_many(chunks, queries, k=4)) == {1: brute(c, everyone, [1.0] * DIM, 4)}
    assert engine.search_many(chunks, queries.limit(0), k=4).count() == 0
    with pytest.raises(ValueError):
        engine.search_many(chunks, queries, remote=True)


def test_hot_job_keeps_its_best_chunk(spark):
    """One job holds most chunks; it must come up once, with its best score."""
    hot = spark.range(0, 20000, 1, 8).select(
        F.lit("hot").alias("job_id"), F.col("id").cast("int").alias("chunk_index"),
        F.array(F.lit(1.0), F.col("id") / 20000).cast("array<float>").alias("embedding"),
    )
    cold = spark.createDataFrame([("a", 0, [1.0, 0.5]), ("b", 0, [1.0, -1.0])], hot.schema)
    postings = spark.createDataFrame([("hot",), ("a",), ("b",)], "job_id string").selectExpr(
        "job_id", "true remote", "1.0D salary_max"
    )
    queries = spark.createDataFrame([(1, [1.0, 0.5])], "query_id int, embedding array<double>")
    got = many(engine.search_many(engine.with_filters(hot.unionByName(cold), postings), queries, 3))
    assert got == {1: [("a", 1.0, 0), ("hot", 1.0, 10000), ("b", 0.316228, 0)]}


def test_cells(spark, table, tmp_path):
    t = Tables(spark, DATA)
    chunks, postings, vector = q.chunks_from(t), q.postings_from(t), q.query_vector(t)
    exact = shown(engine.search(chunks, postings, vector, 8))
    cells.write_cells(cells.build_cells(chunks, 10, 64), str(tmp_path / "cells"))
    index = cells.read_cells(spark, str(tmp_path / "cells"))
    assert shown(cells.search_cells(index, postings, vector, 8, probes=10)) == exact
    some = cells.search_cells(index, postings, vector, 8, probes=5)
    recall = len({j for j, _ in shown(some)} & {j for j, _ in exact}) / len(exact)
    assert recall >= 0.5, recall
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", plan)


def test_cells_keep_vectors_without_direction(spark):
    chunks, postings, c, p = make(spark)
    index = cells.build_cells(chunks, 3, DIM)
    assert index.chunks.count() == len(c)
    got = shown(cells.search_cells(index, postings, [1.0] * DIM, 50, probes=3))
    assert got == [w[:2] for w in brute(c, p, [1.0] * DIM, 50)]


def test_cells_take_given_centres_and_new_chunks(spark, tmp_path):
    chunks, postings, c, p = make(spark)
    odd = spark.createDataFrame(
        [("j1", 900, [float("nan")] + [1.0] * (DIM - 1)), ("j1", 901, [float("inf")] + [0.0] * (DIM - 1)), ("j1", 902, None)],
        chunks.select("job_id", "chunk_index", "embedding").schema,
    )
    rows = chunks.select("job_id", "chunk_index", "embedding")
    path = str(tmp_path / "cells")
    centres = [[1.0] + [0.0] * (DIM - 1), [0.0] * (DIM - 1) + [1.0]]
    cells.write_cells(cells.build_cells(rows.filter("chunk_index % 2 = 0"), 2, DIM, centers=centres), path)
    cells.add_chunks(spark, path, rows.filter("chunk_index % 2 = 1").unionByName(odd))
    index = cells.read_cells(spark, path)
    assert index.centers.tolist() == centres and index.chunks.count() == len(c) + 3
    assert index.chunks.filter("chunk_index >= 900 and cell = -1").count() == 3
    assert cells.build_cells(rows.unionByName(odd), 3, DIM).chunks.filter("chunk_index >= 900 and cell <> -1").count() == 0
    got = shown(cells.search_cells(index, postings, [1.0] * DIM, 50, probes=2))
    assert got == [w[:2] for w in brute(c, p, [1.0] * DIM, 50)]


@pytest.mark.parametrize("block", [200_000, 3])
def test_many_queries_by_cell_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cells, "CHUNK_BLOCK", block)
    monkeypatch.setattr(cells, "QUERY_BLOCK", block)
    chunks, postings, c, p = make(spark, seed=5)
    rng = np.random.default_rng(2)
    vectors = {f"q{i}": [float(x) for x in rng.integers(1, 4, DIM)] for i in range(9)}
    filters = {q: (i % 2 == 0, None if i % 3 else 40.0) for i, q in enumerate(vectors)}
    own = spark.createDataFrame([(q, v, *filters[q]) for q, v in vectors.items()],
                                "query_id string, embedding array<double>, remote_only boolean, min_salary double")
    index = cells.build_cells(engine.with_filters(chunks, postings), 4, DIM)
    got = many(cells.search_many_cells(index, own, 5, probes=4))
    assert got == {q: brute(c, p, v, 5, salary=filters[q][1], remote_only=filters[q][0]) for q, v in vectors.items()}


def test_large_query_sets_are_refused(spark, monkeypatch):
    chunks, *_ = make(spark)
    queries = spark.createDataFrame([(i % 3, [1.0] * DIM) for i in range(4)], "query_id int, embedding array<double>")
    with pytest.raises(ValueError, match="unique"):
        engine.search_many(chunks, queries)
    monkeypatch.setattr(engine, "QUERY_ROWS", 3)
    with pytest.raises(ValueError, match="search_many_cells"):
        engine.search_many(chunks, queries)


def test_both_searches_rank_infinite_vectors_last(spark):
    chunks = spark.createDataFrame([(1, 0, [float("inf"), 1.0]), (2, 0, [1.0, 1.0])], "job_id int, chunk_index int, embedding array<float>")
    postings = spark.createDataFrame([(i, *[None] * 8) for i in (1, 2)], "job_id int, title string, company string, location string, "
                                     "remote boolean, salary_min double, salary_max double, url string, tags array<string>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [j for j, _ in shown(engine.search(chunks, postings, [1.0, 0.0], 2))] == [2, 1]
    assert [j for j, *_ in many(engine.search_many(chunks, queries, 2))[1]] == [2, 1]


def people(spark):
    profiles = spark.createDataFrame(
        [
            (1, 1, "head", "a b c d e f", ["Dev"], None, 50.0, True, None), (2, 2, "a b", "", None, None, None, None, None),
            (3, 3, "", None, None, None, None, False, None),
        ],
        schemas.PROFILES,
    )
    skills = spark.createDataFrame([(1, 1, "sql", 2.0)], schemas.SKILLS)
    return profiles, skills


def letters(df):
    """A stub embedder: counts of the letters a to f."""
    counts = [F.size(F.split("chunk_text", c)) - 1 for c in "abcdef"]
    return df.withColumn("embedding", F.array(*[c.cast("float") for c in counts]))


def test_profiles_drive_the_search(spark):
    chunks, postings, c, p = make(spark)
    profiles, _ = people(spark)
    queries = {r["query_id"]: r for r in profile_queries(profiles, letters).collect()}
    assert sorted(queries) == [1, 2] and queries[2]["embedding"] == [1, 1, 0, 0, 0, 0]
    got = match_profiles(profiles, chunks, postings, letters, 4).withColumnRenamed("user_id", "query_id")
    assert many(got) == {
        1: brute(c, p, [1.0] * 6, 4, salary=50.0, remote_only=True), 2: brute(c, p, [1.0, 1, 0, 0, 0, 0], 4),
    }


def test_prompts_and_drafts_through_a_model(spark):
    profiles, skills = people(spark)
    postings = spark.createDataFrame([("a", "src", "Dev", None, None, None, None, None, "d" * 3000, None, None, None, "{}", None)], schemas.POSTINGS)
    pairs = spark.createDataFrame([(1, "a"), (3, "a"), (9, "a"), (1, "none")], "user_id bigint, job_id string")
    echo = lambda: (lambda texts: list(texts))
    told = {r["user_id"]: r["completion"] for r in explain_matches(pairs, profiles, skills, postings, echo).collect()}
    assert sorted(told) == [1, 3, 9]
    assert "Skills: sql (2.0y)" in told[1] and "Company: unknown company" in told[1] and told[1].count("d" * 1500) == 1
    assert "d" * 1501 not in told[1]
    assert "Headline: not specified" in told[3] and "Headline: not specified" in told[9]
    saved = spark.createDataFrame([], schemas.SAVED_JOBS)
    applications = spark.createDataFrame([], schemas.APPLICATIONS)
    requests = pairs.selectExpr("user_id", "job_id", "user_id as seq", "timestamp'2024-01-01' as ts")
    done = draft_materials(requests, profiles, skills, postings, saved, applications, echo, "resume_bullet")
    texts = {r["saved_job_id"]: r for r in done.applications.collect()}
    assert len(texts) == 3 and all("d" * 1001 not in r["resume_bullet"] for r in texts.values())
    assert all(r["cover_letter"] is None for r in texts.values())
    assert [r["job_id"] for r in done.rejected.collect()] == ["none"]


def test_text_queries_equal_brute_force(spark):
    t = Tables(spark, DATA)
    chunk_rows = [tuple(r) for r in q.text_chunks(t).select("job_id", "chunk_index", "embedding").collect()]
    posting_rows = [tuple(r) for r in q.text_postings(t).select(*engine.SHOWN).collect()]
    embed = q.word_counts
    said = embed(spark.createDataFrame([("the and of",)], "chunk_text string")).first()["embedding"]
    found = QUERIES["search_by_text"](spark, DATA)
    assert shown(found) == [w[:2] for w in brute(chunk_rows, posting_rows, said, 8, salary=1500)]

    people = {r["query_id"]: r for r in profile_queries(q.speakers(t), embed).collect()}
    got = many(QUERIES["profile_matches"](spark, DATA).withColumnRenamed("user_id", "query_id"))
    assert sorted(got) == sorted(people) and len(people) == t("conversations").select("conv_id").distinct().count()
    for user, row in people.items():
        want = brute(chunk_rows, posting_rows, row["embedding"], 8, salary=row["min_salary"], remote_only=row["remote_only"])
        assert got[user] == want
