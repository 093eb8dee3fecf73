"""Vector-search queries: documents are postings, four vectors make one job's chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from trackweave import schemas
from trackweave.functions.models import hashing_embedder
from trackweave.functions.text import UNICODE_SPACE
from trackweave.functions.vectors import cosine_similarity, mean_vectors
from trackweave.operators import cells, hyperplanes
from trackweave.operators.search import best_per_job, search, search_many, with_filters
from trackweave.plans.ingest import chunk_rows
from trackweave.plans.matching import match_profiles, search_text
from trackweave.plans.registry import Tables, query
from trackweave.plans.text_queries import chunk_sql
from trackweave.session import forget, materialize, work_dir
from trackweave.sources.tables import KeyedTable
from trackweave.streaming import streams

K = 8


def chunks_from(t: Tables) -> DataFrame:
    return t("embeddings").select(
        F.floor(F.col("vec_id") / 4).cast("bigint").alias("job_id"),
        (F.col("vec_id") % 4).cast("int").alias("chunk_index"),
        "embedding",
        "vec_id",
    )


def postings_from(t: Tables) -> DataFrame:
    lang, n = F.col("lang"), F.col("n_chars").cast("double")
    return t("documents").select(
        F.col("doc_id").alias("job_id"),
        F.concat(F.lit("doc "), "doc_id").alias("title"),
        F.col("source").alias("company"),
        F.col("lang").alias("location"),
        F.when(lang != "de", lang == "en").alias("remote"),
        (n / 2).alias("salary_min"),
        F.when(lang != "fr", n).alias("salary_max"),
        F.concat(F.lit("/d/"), "doc_id").alias("url"),
        F.array("lang", "source").alias("tags"),
    )


def query_vector(t: Tables) -> list[float]:
    """The mean of all vectors: 64 numbers, the one thing collected."""
    row = mean_vectors(t("embeddings").withColumn("_one", F.lit(1)), ["_one"]).first()
    return row["embedding"]


BASE_SQL = """
chunks AS (SELECT vec_id // 4 AS job_id, CAST(vec_id % 4 AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS v, vec_id FROM embeddings),
postings AS (
  SELECT doc_id AS job_id, 'doc ' || doc_id AS title, source AS company, lang AS location,
    CASE WHEN lang <> 'de' THEN lang = 'en' END AS remote, n_chars / 2 AS salary_min,
    CASE WHEN lang <> 'fr' THEN CAST(n_chars AS DOUBLE) END AS salary_max, '/d/' || doc_id AS url, lang || ',' || source AS tags
  FROM documents),
elements AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
q AS (SELECT list(m ORDER BY pos) AS qv FROM (SELECT pos, avg(x) AS m FROM elements GROUP BY pos)),
scored AS (SELECT c.*, list_cosine_similarity(v, qv) AS sim FROM chunks c CROSS JOIN q),
best AS (
  SELECT job_id, chunk_index, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sim DESC, chunk_index) AS rn FROM scored) WHERE rn = 1)
"""
SHOWN_SQL = (
    "job_id, title, company, location, CAST(remote AS VARCHAR) AS remote, salary_min, salary_max, url, tags, round(sim, 6) AS similarity"
)


def _flat(found: DataFrame) -> DataFrame:
    return found.withColumns(
        {
            "tags": F.array_join("tags", ","),
            "remote": F.col("remote").cast("string"),
            "similarity": F.round("similarity", 6),
        }
    )


SEARCH_SQL = f"WITH {BASE_SQL} SELECT {SHOWN_SQL} FROM best JOIN postings USING (job_id) ORDER BY sim DESC, job_id LIMIT {K}"


@query(SEARCH_SQL)
def search_topk(t: Tables) -> DataFrame:
    return _flat(search(chunks_from(t), postings_from(t), query_vector(t), K))


@query(SEARCH_SQL)
def search_topk_native(t: Tables) -> DataFrame:
    """The same with built-in expressions only, no Python worker."""
    return _flat(search(chunks_from(t), postings_from(t), query_vector(t), K, engine="native"))


@query(f"WITH {BASE_SQL} SELECT {SHOWN_SQL} FROM (SELECT * FROM best JOIN postings USING (job_id) ORDER BY job_id LIMIT {K})")
def search_keymode(t: Tables) -> DataFrame:
    """Limit by job id first, then rank."""
    return _flat(search(chunks_from(t), postings_from(t), query_vector(t), K, limit_order="key"))


@query(f"""
WITH {BASE_SQL} SELECT {SHOWN_SQL} FROM best JOIN postings USING (job_id)
WHERE remote = true AND (salary_max IS NULL OR salary_max >= 1500) ORDER BY sim DESC, job_id LIMIT {K}
""")
def search_filtered(t: Tables) -> DataFrame:
    found = search(chunks_from(t), postings_from(t), query_vector(t), K, remote=True, min_salary=1500)
    return _flat(found)


@query(f"WITH {BASE_SQL} SELECT job_id, chunk_index, round(sim, 6) AS similarity FROM best")
def best_chunk(t: Tables) -> DataFrame:
    best = best_per_job(chunks_from(t), query_vector(t), with_chunk=True)
    return best.select("job_id", "chunk_index", F.round("similarity", 6).alias("similarity"))


@query("""
WITH elements AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, list(m ORDER BY pos) AS mv FROM (SELECT label, pos, avg(x) AS m FROM elements GROUP BY ALL) GROUP BY label)
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), mv), 6) AS similarity
FROM embeddings JOIN means USING (label)
""")
def vector_similarity(t: Tables) -> DataFrame:
    """Every vector against the mean vector of its label."""
    means = mean_vectors(t("embeddings"), ["label"]).withColumnRenamed("embedding", "mean")
    similarity = F.round(cosine_similarity(F.col("embedding"), F.col("mean")), 6)
    return t("embeddings").join(means, "label").select("vec_id", "label", similarity.alias("similarity"))


def _group_queries(t: Tables) -> DataFrame:
    """One query per source and language: the mean vector of its documents."""
    vectors = t("embeddings").join(t("documents"), F.col("vec_id") == F.col("doc_id"))
    return mean_vectors(vectors.withColumn("query_id", F.concat_ws("-", "lang", "source")), ["query_id"])


GROUPS_SQL = """
grouped AS (SELECT vec_id, lang || '-' || source AS query_id, source FROM documents JOIN embeddings ON vec_id = doc_id),
queries AS (
  SELECT query_id, list(m ORDER BY pos) AS qv FROM (
    SELECT query_id, pos, avg(x) AS m FROM elements JOIN grouped USING (vec_id) GROUP BY ALL) GROUP BY query_id),
by_query AS (
  SELECT query_id, job_id, chunk_index, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, job_id ORDER BY sim DESC, chunk_index) AS rn
    FROM (SELECT query_id, job_id, chunk_index, list_cosine_similarity(v, qv) AS sim FROM chunks CROSS JOIN queries)) WHERE rn = 1)
"""


def _stored_chunks(t: Tables) -> DataFrame:
    """Chunks written once with the columns that filters use."""
    return materialize(with_filters(chunks_from(t), postings_from(t)), "chunks")


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("similarity", F.round("similarity", 6))


BATCH_SQL = f"""
WITH {BASE_SQL}, {GROUPS_SQL}
SELECT query_id, CAST(rank AS INTEGER) AS rank, job_id, chunk_index, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, job_id) AS rank FROM by_query JOIN postings USING (job_id))
WHERE rank <= {K}
"""


@query(BATCH_SQL)
def search_batch_pruned(t: Tables) -> DataFrame:
    """The same through cells, exact: cells out of a query's reach are not visited."""
    return _ranked(cells.search_many_pruned(in_cells(_stored_chunks(t)), _group_queries(t), K))


@query(BATCH_SQL)
def search_batch(t: Tables) -> DataFrame:
    """Many queries in one pass over the chunks."""
    return _ranked(search_many(_stored_chunks(t), _group_queries(t), K))


@query(f"""
WITH {BASE_SQL}, {GROUPS_SQL},
users AS (SELECT lang || '-' || source AS query_id, lang = 'en' AS remote_only, CASE WHEN lang <> 'es' THEN max(n_chars) / 4 END AS min_salary
  FROM documents GROUP BY lang, source)
SELECT query_id, CAST(rank AS INTEGER) AS rank, job_id, chunk_index, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, job_id) AS rank
  FROM by_query JOIN postings USING (job_id) JOIN users USING (query_id)
  WHERE (NOT remote_only OR remote = true) AND (min_salary IS NULL OR salary_max IS NULL OR salary_max >= min_salary))
WHERE rank <= {K}
""")
def search_profiles(t: Tables) -> DataFrame:
    """Many queries, each with filters of its own."""
    return _ranked(search_many(_stored_chunks(t), _filtered_queries(t), K))


def _filtered_queries(t: Tables) -> DataFrame:
    filters = t("documents").groupBy("lang", "source").agg((F.max("n_chars") / 4).alias("_quarter")).select(
        F.concat_ws("-", "lang", "source").alias("query_id"),
        (F.col("lang") == "en").alias("remote_only"),
        F.when(F.col("lang") != "es", F.col("_quarter")).alias("min_salary"),
    )
    return _group_queries(t).join(filters, "query_id")


def _cells(t: Tables) -> cells.CellIndex:
    return cells.build_cells(chunks_from(t), 10, 64)


def _label_centers(t: Tables) -> list[list[float]]:
    """One centre per label, the mean of its vectors (as many as there are labels)."""
    rows = mean_vectors(t("embeddings"), ["label"]).orderBy("label").collect()
    return [row["embedding"] for row in rows]


# Cells by the same rule: every vector, and every query, to the nearest mean by cosine, ties to the lower number.
CELLS_SQL = """
means AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cell, mv FROM (
  SELECT label, list(m ORDER BY pos) AS mv FROM (
    SELECT label, pos, avg(x) AS m FROM elements JOIN embeddings USING (vec_id) GROUP BY ALL) GROUP BY label)),
celled AS (
  SELECT vec_id, cell FROM (
    SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, mv), 12) DESC, cell) AS rn
    FROM chunks CROSS JOIN means) WHERE rn = 1)
"""


@query(f"""
WITH {BASE_SQL}, {CELLS_SQL},
probed AS (SELECT cell FROM means CROSS JOIN q ORDER BY round(list_cosine_similarity(mv, qv), 12) DESC, cell LIMIT 4),
near AS (
  SELECT job_id, max(sim) AS sim FROM scored JOIN celled USING (vec_id) WHERE cell IN (SELECT cell FROM probed) GROUP BY job_id)
SELECT {SHOWN_SQL} FROM near JOIN postings USING (job_id) ORDER BY sim DESC, job_id LIMIT {K}
""")
def search_ann(t: Tables) -> DataFrame:
    """Approximate: the four nearest of the cells around the labels' means."""
    index = cells.build_cells(chunks_from(t), 0, 64, centers=_label_centers(t))
    return _flat(cells.search_cells(index, postings_from(t), query_vector(t), K, probes=4))


@query(SEARCH_SQL)
def search_cells_appended(t: Tables) -> DataFrame:
    """Cells built on half of the chunks, the other half appended, all probed."""
    path = f"{work_dir(t.spark)}/cells-{uuid.uuid4().hex}"
    half = F.col("vec_id") % 2 == 0
    cells.write_cells(cells.build_cells(chunks_from(t).filter(half), 10, 64), path)
    cells.add_chunks(t.spark, path, chunks_from(t).filter(~half))
    index = cells.read_cells(t.spark, path)
    return _flat(cells.search_cells(index, postings_from(t), query_vector(t), K, probes=10))


@query(f"""
WITH {BASE_SQL}, {GROUPS_SQL}, {CELLS_SQL},
users AS (SELECT lang || '-' || source AS query_id, lang = 'en' AS remote_only, CASE WHEN lang <> 'es' THEN max(n_chars) / 4 END AS min_salary
  FROM documents GROUP BY lang, source),
probed AS (
  SELECT query_id, cell FROM (
    SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(mv, qv), 12) DESC, cell) AS rn
    FROM queries CROSS JOIN means) WHERE rn <= 4),
near AS (
  SELECT query_id, job_id, chunk_index, sim FROM (
    SELECT query_id, job_id, chunk_index, sim, row_number() OVER (PARTITION BY query_id, job_id ORDER BY sim DESC, chunk_index) AS rn
    FROM (SELECT query_id, job_id, chunk_index, list_cosine_similarity(v, qv) AS sim
      FROM chunks JOIN celled USING (vec_id) JOIN probed USING (cell) JOIN queries USING (query_id))) WHERE rn = 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, job_id, chunk_index, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, job_id) AS rank
  FROM near JOIN postings USING (job_id) JOIN users USING (query_id)
  WHERE (NOT remote_only OR remote = true) AND (min_salary IS NULL OR salary_max IS NULL OR salary_max >= min_salary))
WHERE rank <= {K}
""")
def search_profiles_cells(t: Tables) -> DataFrame:
    """Many queries with filters of their own, each over its four nearest cells."""
    index = cells.build_cells(_stored_chunks(t), 0, 64, centers=_label_centers(t))
    return _ranked(cells.search_many_cells(index, _filtered_queries(t), K, probes=4))


@query(SEARCH_SQL)
def search_ann_all_cells(t: Tables) -> DataFrame:
    """Stored cells, all probed: equal to the exact search."""
    path = f"{work_dir(t.spark)}/cells-{uuid.uuid4().hex}"
    cells.write_cells(_cells(t), path)
    index = cells.read_cells(t.spark, path)
    return _flat(cells.search_cells(index, postings_from(t), query_vector(t), K, probes=10))


# Hyperplanes by the same rule: 4 tables of 8, normals of +1 and -1 by the first digit of md5.
HASHED_SQL = f"""
WITH {BASE_SQL},
planes AS (
  SELECT p, list(CASE WHEN substr(md5(p || '-' || d), 1, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS normal
  FROM range(32) a(p) CROSS JOIN range(64) b(d) GROUP BY p),
sides AS (
  SELECT vec_id, p // 8 AS tab, p % 8 AS bit, list_dot_product(v, normal) / sqrt(list_dot_product(v, v)) AS x
  FROM chunks CROSS JOIN planes),
coded AS (SELECT vec_id, tab, sum(CASE WHEN x >= 0 THEN 1 << bit ELSE 0 END) AS code FROM sides GROUP BY ALL),
costs AS (
  SELECT vec_id AS query_id, tab, code, round(sum(CASE WHEN (x >= 0) <> ((code >> bit) & 1 = 1) THEN x * x ELSE 0 END), 9) AS cost
  FROM sides CROSS JOIN (SELECT CAST(c AS INTEGER) AS code FROM range(256) r(c)) WHERE vec_id % 50 = 0 GROUP BY ALL),
probed AS (
  SELECT query_id, tab, code FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, tab ORDER BY cost, code) AS place FROM costs) WHERE place <= 48),
met AS (SELECT DISTINCT query_id, vec_id FROM probed JOIN coded USING (tab, code)),
near AS (
  SELECT query_id, job_id, chunk_index, round(list_cosine_similarity(c.v, q.v), 12) AS sim
  FROM met JOIN chunks c USING (vec_id) JOIN (SELECT vec_id AS query_id, v FROM chunks) q USING (query_id)),
per_job AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, job_id ORDER BY sim DESC, chunk_index) AS rn FROM near) WHERE rn = 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, job_id, chunk_index, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, job_id) AS rank FROM per_job)
WHERE rank <= {K}
"""


@query(HASHED_SQL)
def search_hashed(t: Tables) -> DataFrame:
    """Every fiftieth vector as a query, over its cheapest hash buckets in four tables of eight hyperplanes."""
    planes = hyperplanes.sign_planes(64, 4, 8)
    hashed = materialize(hyperplanes.hash_chunks(chunks_from(t), planes), "hashed")
    asked = t("embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return _ranked(hyperplanes.search_many_hashed(hashed, planes, asked, K))


TEXT_DIM = 64


def word_counts(df: DataFrame) -> DataFrame:
    """An embedder that SQL can repeat: counts of words by the first digits of their md5."""
    words = F.filter(F.split(F.lower("chunk_text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % TEXT_DIM)
    every = F.sequence(F.lit(0), F.lit(TEXT_DIM - 1))
    # The places go through a lambda of their own, so that they are computed once and not for every number.
    counts = F.transform(F.array(places), lambda at: F.transform(every, lambda i: F.size(F.filter(at, lambda p: p == i)).cast("float")))
    return df.withColumn("embedding", F.get(counts, 0))


def words_sql(text: str) -> str:
    places = (
        f"list_transform(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''), "
        "lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 64)"
    )
    return f"(SELECT list_transform(range(64), lambda i: len(list_filter(p, lambda x: x = i))::DOUBLE) FROM (SELECT {places} AS p))"


TEXT_SQL = f"""
{BASE_SQL}, {chunk_sql()},
texts AS (SELECT CAST(doc_id AS VARCHAR) AS job_id, chunk_index, {words_sql("chunk_text")} AS tv FROM pieces),
listings AS (SELECT * REPLACE (CAST(job_id AS VARCHAR) AS job_id) FROM postings)
"""
TEXT_SIM = "CASE WHEN list_sum(tv) > 0 AND list_sum(wv) > 0 THEN round(list_cosine_similarity(tv, wv), 12) END"


def text_chunks(t: Tables) -> DataFrame:
    """All documents chunked and embedded by counts of words, stored as chunks are."""
    documents = t("documents").select(F.col("doc_id").cast("string").alias("job_id"), F.col("text").alias("description"))
    return materialize(chunk_rows(documents, F.lit("2024-01-01").cast("timestamp"), word_counts), "text-chunks")


def text_postings(t: Tables) -> DataFrame:
    return postings_from(t).withColumn("job_id", F.col("job_id").cast("string"))


@query(f"""
WITH {TEXT_SQL}, said AS (SELECT {words_sql("'the and of'")} AS wv),
near AS (SELECT job_id, max({TEXT_SIM}) AS sim FROM texts CROSS JOIN said GROUP BY job_id)
SELECT {SHOWN_SQL} FROM near JOIN listings USING (job_id) WHERE salary_max IS NULL OR salary_max >= 1500
ORDER BY sim DESC NULLS LAST, job_id LIMIT {K}
""")
def search_by_text(t: Tables) -> DataFrame:
    """From a query text to postings: chunk, embed, filter, rank."""
    found = search_text(
        text_chunks(t), text_postings(t), "the and of", word_counts, K, min_salary=1500
    )
    return _flat(found)


def in_cells(chunks: DataFrame) -> cells.CellIndex:
    """About as many cells as chunks in a cell, stored."""
    n, dim = chunks.agg(F.count("*"), F.max(F.size("embedding"))).first()
    number = max(1, min(4096, int(n**0.5)))
    index = cells.build_cells(chunks, number, dim, centers=cells.sample_centers(chunks, number, dim))
    return cells.CellIndex(materialize(index.chunks, "in_cells"), index.centers)


def speakers(t: Tables) -> DataFrame:
    """Every conversation as a profile: its first message is the summary."""
    return t("conversations").groupBy(F.col("conv_id").alias("user_id")).agg(
        F.min_by("text", "turn").alias("summary"),
        F.lit("").alias("headline"),
        (F.count("*") > 4).alias("remote_only"),
        F.when(F.count("*") > 2, F.count("*") * 100.0).alias("min_salary"),
    )


@query(f"""
WITH {TEXT_SQL},
people AS (
  SELECT conv_id AS user_id, {words_sql("arg_min(text, turn)")} AS wv, count(*) > 4 AS remote_only,
    CASE WHEN count(*) > 2 THEN count(*) * 100.0 END AS min_salary
  FROM conversations GROUP BY conv_id HAVING arg_min(text, turn) <> ''),
near AS (
  SELECT user_id, job_id, chunk_index, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY sim DESC NULLS LAST, chunk_index) AS rn
    FROM (SELECT user_id, job_id, chunk_index, {TEXT_SIM} AS sim FROM texts CROSS JOIN people)) WHERE rn = 1)
SELECT user_id, CAST(rank AS INTEGER) AS rank, job_id, chunk_index, round(sim, 6) AS similarity FROM (
  SELECT near.*, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC NULLS LAST, job_id) AS rank
  FROM near JOIN listings USING (job_id) JOIN people USING (user_id)
  WHERE (NOT remote_only OR remote = true) AND (min_salary IS NULL OR salary_max IS NULL OR salary_max >= min_salary))
WHERE rank <= {K}
""")
def profile_matches(t: Tables) -> DataFrame:
    """The best postings of every profile under its own filters, from texts alone; cells out of reach are not visited."""
    stored = text_chunks(t)
    # From here on vectors do; the texts, as large as the input, are not moved along and not kept.
    chunks = materialize(with_filters(stored.select("job_id", "chunk_index", "embedding"), text_postings(t)), "chunks")
    forget(stored)
    return _ranked(match_profiles(speakers(t), in_cells(chunks), embed=word_counts, k=K))


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS job_id,
  CASE WHEN length(s) <= 800 THEN 1 ELSE CAST(ceil(length(s) / 700.0) AS BIGINT) END AS chunks
FROM (SELECT doc_id, trim(text, '{UNICODE_SPACE}') AS s FROM documents) WHERE length(s) > 0
""")
def embed_stream(t: Tables) -> DataFrame:
    """Documents streamed into a stored chunk table, then the same ones again."""
    folder = f"{work_dir(t.spark)}/embed-{uuid.uuid4().hex}"
    store = KeyedTable(t.spark, f"{folder}/chunks", schemas.CHUNKS, ["job_id", "chunk_index"], ["job_id"], parts=4, buckets=8)
    arriving = t.stream("documents").select(
        F.col("doc_id").cast("string").alias("job_id"), F.col("text").alias("description")
    )
    at = F.lit("2024-01-01").cast("timestamp")
    for run in ("first", "again"):
        streams.embed_stream(
            arriving, store, f"{folder}/{run}", at, embed=hashing_embedder(dim=64)
        ).awaitTermination()
    return store.read().groupBy("job_id").agg(F.count("*").alias("chunks"))


