"""Cleaning, chunking, prompt and scalar-function queries over the given tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trackweave import schemas
from trackweave.functions import text as tx
from trackweave.functions.models import complete, hashing_embedder
from trackweave.operators import chunking, cleaning, keyed, prompts, reports
from trackweave.plans.ingest import chunk_rows, embed_new, ingest_listings, store_chunks
from trackweave.plans.registry import Tables, query
from trackweave.session import work_dir
from trackweave.sources.arrays import read_array_listings
from trackweave.sources.listings import impose_schema, parse_listings, query_table, read_listings
from trackweave.sources.tables import KeyedTable
from trackweave.streaming import streams

SPACE = tx.UNICODE_SPACE

# Frequent words of the documents, standing in for a tag vocabulary.
VOCABULARY = ("the", "and", "of", "la", "le", "der", "die", "el")
MODEL_DIM = 64


def raw_documents(documents: DataFrame) -> DataFrame:
    """Documents in the shape of raw listings; fr has no location, de garbage salaries."""
    lang = F.col("lang")
    return documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("slug"),
        F.col("source").alias("company"),
        F.concat(F.lit("  "), F.col("source"), F.lit(" ")).alias("position"),
        F.when(lang == "en", "Remote - EN").when(lang == "es", "").when(lang == "de", "Berlin").alias("location"),
        F.array("lang", "source").alias("tags"),
        F.col("text").alias("description"),
        F.concat(F.lit("http://example.org/"), F.col("doc_id")).alias("url"),
        F.when(lang == "es", "garbage")
        .otherwise(F.concat(F.lit("2024-01-02T03:04:"), F.lpad(F.length("source").cast("string"), 2, "0")))
        .alias("date"),
        F.when(lang == "de", "12k").otherwise(F.col("n_chars").cast("string")).alias("salary_min"),
        F.when(lang != "en", F.col("n_chars").cast("string")).alias("salary_max"),
    )


RAW_SQL = """
raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS company, '  ' || source || ' ' AS "position",
    CASE lang WHEN 'en' THEN 'Remote - EN' WHEN 'es' THEN '' WHEN 'de' THEN 'Berlin' END AS location,
    lang || ',' || source AS tags, text AS description, 'http://example.org/' || doc_id AS url,
    CASE WHEN lang = 'es' THEN 'garbage'
      ELSE '2024-01-02T03:04:' || lpad(CAST(length(source) AS VARCHAR), 2, '0') END AS date,
    CASE WHEN lang = 'de' THEN '12k' ELSE CAST(n_chars AS VARCHAR) END AS salary_min,
    CASE WHEN lang <> 'en' THEN CAST(n_chars AS VARCHAR) END AS salary_max
  FROM documents)
"""
CLEAN_SQL = f"""
WITH {RAW_SQL}
SELECT id AS job_id, 'feed' AS source, trim("position", ' ') AS title, company, location,
  location IS NULL OR contains(lower(location), 'remote') AS remote,
  TRY_CAST(salary_min AS DOUBLE) AS salary_min, TRY_CAST(salary_max AS DOUBLE) AS salary_max,
  trim(description, ' ') AS description, tags, url,
  CAST(TRY_CAST(date AS TIMESTAMP) AS VARCHAR) AS posted_at
FROM raw WHERE id <> '' AND length(description) > 0
"""


def _flat(cleaned: DataFrame) -> DataFrame:
    return cleaned.withColumns(
        {"tags": F.array_join("tags", ","), "posted_at": F.col("posted_at").cast("string")}
    )


@query(CLEAN_SQL)
def clean_documents(t: Tables) -> DataFrame:
    return _flat(cleaning.clean_listings(raw_documents(t("documents")), "feed"))


# Spanish listings have no readable date: their older, dated copy wins.
DATED_SQL = f"""
SELECT job_id, source, title, company, location, remote, salary_min, salary_max,
  CASE WHEN posted_at IS NULL THEN 'old' ELSE description END AS description, tags, url,
  coalesce(posted_at, '2020-01-01 00:00:00') AS posted_at
FROM ({CLEAN_SQL})
"""


@query(DATED_SQL)
def several_feeds(t: Tables) -> DataFrame:
    """Two feeds of JSON files, an older copy of every listing in the second, read together and de-duplicated."""
    raw = raw_documents(t("documents"))
    older = raw.withColumns({"date": F.lit("2020-01-01T00:00:00"), "description": F.lit("old")})
    folder = f"{work_dir(t.spark)}/feeds-{uuid.uuid4().hex}"
    raw.write.json(f"{folder}/a")
    older.write.json(f"{folder}/b")
    listings = read_listings(t.spark, [f"{folder}/a", f"{folder}/b"], lines=True)
    return _flat(cleaning.clean_listings(listings, "feed"))


@query(DATED_SQL)
def parse_json_listings(t: Tables) -> DataFrame:
    """The same from JSON text, with every listing repeated in an older copy and a notice per row."""
    raw = raw_documents(t("documents"))
    older = raw.withColumns({"date": F.lit("2020-01-01T00:00:00"), "description": F.lit("old")})
    notice = raw.select(F.lit('{"legal": "notice"}').alias("body"))
    bodies = raw.unionByName(older).select(F.to_json(F.struct(*raw.columns)).alias("body")).unionByName(notice)
    return _flat(cleaning.clean_listings(parse_listings(bodies, "body"), "feed"))


@query(CLEAN_SQL)
def array_feeds(t: Tables) -> DataFrame:
    """Feeds as array files, split at byte ranges; every file has a broken object, which becomes a reject."""
    raw = raw_documents(t("documents"))

    def lines(batches):
        yield pd.DataFrame({"value": ['[{"id": broken}']})
        for batch in batches:
            yield pd.DataFrame({"value": ", " + batch["value"]})
        yield pd.DataFrame({"value": ["]"]})

    folder = f"{work_dir(t.spark)}/arrays-{uuid.uuid4().hex}"
    raw.select(F.to_json(F.struct(*raw.columns)).alias("value")).mapInPandas(lines, "value string").write.text(folder)
    listings, _ = read_array_listings(t.spark, folder)
    return _flat(cleaning.clean_listings(listings, "feed"))


@query(CLEAN_SQL)
def ingest_stream(t: Tables) -> DataFrame:
    """The same as a stream into a stored postings table, and once more as a replay."""
    folder = f"{work_dir(t.spark)}/ingest-{uuid.uuid4().hex}"
    store = KeyedTable(t.spark, f"{folder}/postings", schemas.POSTINGS, ["job_id"], parts=4, buckets=8)
    at = F.lit("2024-01-01").cast("timestamp")
    for run in ("first", "replay"):
        arriving = impose_schema(cleaning.drop_notices(raw_documents(t.stream("documents"))))
        streams.ingest_stream(arriving, store, "feed", f"{folder}/{run}", at).awaitTermination()
    return _flat(store.read().drop("payload", "synced_at"))


@query("""
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level,
  coalesce(TRY_CAST(o_orderpriority AS DOUBLE), -1.0) AS level_of_text,
  CAST(TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END
    AS TIMESTAMP) AS VARCHAR) AS day
FROM orders
""")
def tolerant_cast(t: Tables) -> DataFrame:
    date = F.when(F.col("o_orderstatus") == "F", "soon").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    )
    return t("orders").select(
        "o_orderkey",
        tx.to_number(F.substring("o_orderpriority", 1, 1)).alias("level"),
        F.coalesce(tx.to_number(F.col("o_orderpriority")), F.lit(-1.0)).alias("level_of_text"),
        tx.to_time(date).cast("string").alias("day"),
    )


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
WHERE rn = 1
""")
def dedupe_latest(t: Tables) -> DataFrame:
    latest = keyed.latest_per_key(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"])
    return latest.select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("string"))


@query(f"""
SELECT doc_id, lang, n_chars FROM documents
WHERE (lang = 'de' AND n_chars > 0)
  OR (len(list_intersect(string_split(lower(text), ' '), {list(VOCABULARY)})) >= 2 AND length(text) >= 200)
""")
def junk_filter(t: Tables) -> DataFrame:
    rows = t("documents").withColumns(
        {"tags": F.split("text", " "), "salary": F.when(F.col("lang") == "de", F.col("n_chars"))}
    )
    kept = cleaning.not_junk(rows, VOCABULARY, 2, 200, description="text", salaries=["salary"])
    return kept.select("doc_id", "lang", "n_chars")


@query("""
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customers' AS source FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_acctbal, NULL, 'suppliers' FROM supplier
""")
def union_sources(t: Tables) -> DataFrame:
    customers = t("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    suppliers = t("supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return cleaning.union_sources({"customers": customers, "suppliers": suppliers})


@query("""
SELECT c_custkey, CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
  'segment': CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END}) AS VARCHAR) AS payload
FROM customer
""")
def payload_json(t: Tables) -> DataFrame:
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment")
    return t("customer").select(
        "c_custkey", tx.row_json("c_custkey", "c_name", "c_nationkey", segment).alias("payload")
    )


@query("""
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k,
  CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS at
FROM events
""")
def json_arguments(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "error", "{broken").when(kind == "view", F.concat(F.lit(" "), "props")).otherwise(F.col("props"))
    return t("events").select(
        "event_id",
        F.coalesce(tx.json_fields(text, "k bigint")["k"], F.lit(-1)).alias("k"),
        tx.iso_time(F.col("ts")).alias("at"),
    )


def chunk_sql(source: str = "documents") -> str:
    return f"""
stripped AS (SELECT doc_id, trim(text, '{SPACE}') AS s FROM {source}),
pieces AS (
  SELECT doc_id, CAST(start // 700 AS INTEGER) AS chunk_index, substring(s, CAST(start AS BIGINT) + 1, 800) AS chunk_text
  FROM (SELECT doc_id, s, unnest(CASE WHEN length(s) <= 800 THEN [0] ELSE range(0, length(s), 700) END) AS start
        FROM stripped WHERE length(s) > 0))
"""


@query(f"WITH {chunk_sql()} SELECT * FROM pieces")
def chunk_documents(t: Tables) -> DataFrame:
    return chunking.chunk(t("documents"), ["doc_id"], "text")


def _unlabelled(t: Tables) -> DataFrame:
    return chunking.without_chunks(t("documents"), t("labels"), key="doc_id", text="text")


UNEMBEDDED_SQL = f"""
SELECT doc_id, lang, source FROM documents d
WHERE length(trim(text, '{SPACE}')) > 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
"""


@query(UNEMBEDDED_SQL)
def unembedded(t: Tables) -> DataFrame:
    return _unlabelled(t).select("doc_id", "lang", "source")


@query(UNEMBEDDED_SQL)
def unembedded_by_ids(t: Tables) -> DataFrame:
    """The same, with the ids found before any text is fetched."""
    found = chunking.fetch_without_chunks(t("documents"), t("labels"), key="doc_id", text="text")
    return found.select("doc_id", "lang", "source")


@query(f"""
WITH todo AS (SELECT * FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
{chunk_sql("todo")}
SELECT CAST(doc_id AS VARCHAR) AS job_id, chunk_index, CAST(length(chunk_text) AS BIGINT) AS chars,
  md5(chunk_text) AS text_md5, CAST({MODEL_DIM} AS INTEGER) AS dims,
  CASE WHEN regexp_matches(chunk_text, '[\\p{{L}}\\p{{N}}_]') THEN 1.0 ELSE 0.0 END AS length_of_vector
FROM pieces
""")
def embed_unembedded(t: Tables) -> DataFrame:
    """Incremental embedding: anti join, chunk, embed; vectors have length one."""
    todo = _unlabelled(t).select(F.col("doc_id").cast("string").alias("job_id"), F.col("text").alias("description"))
    rows = chunk_rows(todo, F.lit("2024-01-01").cast("timestamp"), hashing_embedder(dim=MODEL_DIM))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(
        "job_id",
        "chunk_index",
        F.length("chunk_text").cast("bigint").alias("chars"),
        F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"),
        F.size("embedding").alias("dims"),
        F.round(F.sqrt(squares), 3).alias("length_of_vector"),
    )


@query(f"""
WITH {chunk_sql()}
SELECT CAST(doc_id AS VARCHAR) AS job_id, chunk_index, md5(CASE WHEN doc_id % 2 = 0 THEN 'new ' || chunk_text ELSE chunk_text END) AS text_md5,
  CASE WHEN doc_id % 2 = 0 THEN 'second' ELSE 'first' END AS model_name, '2024-01-01 00:00:00' AS created_at
FROM pieces
""")
def chunks_updated(t: Tables) -> DataFrame:
    """Stored chunks, then new texts under the keys of every second document: known keys keep their creation time."""
    store = KeyedTable(
        t.spark, f"{work_dir(t.spark)}/chunks-{uuid.uuid4().hex}", schemas.CHUNKS, ["job_id", "chunk_index"], ["job_id"], parts=4, buckets=8
    )
    docs = t("documents").select(F.col("doc_id").cast("string").alias("job_id"), F.col("text").alias("description"))
    embed = hashing_embedder(dim=MODEL_DIM)
    first = chunk_rows(docs, F.lit("2024-01-01").cast("timestamp"), embed, "first")
    store.append(first)
    even = first.filter(F.col("job_id").cast("bigint") % 2 == 0).withColumns({
        "chunk_text": F.concat(F.lit("new "), "chunk_text"), "model_name": F.lit("second"),
        "created_at": F.lit("2024-02-01").cast("timestamp"),
    })
    store_chunks(store, even)
    return store.read().select(
        "job_id", "chunk_index", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"), "model_name",
        F.col("created_at").cast("string"),
    )


@query(f"""
SELECT page_id, array_to_string(list_filter(list_transform(string_split(url, '/'), lambda x: trim(x, '{SPACE}')),
  lambda x: x <> ''), '|') AS parts,
  array_to_string(list_filter(list_transform(string_split(html, '<p>'), lambda x: trim(x, '{SPACE}')),
  lambda x: x <> ''), '|') AS paragraphs
FROM pages
""")
def split_list(t: Tables) -> DataFrame:
    return t("pages").select(
        "page_id",
        F.array_join(tx.split_list(F.col("url"), "/"), "|").alias("parts"),
        F.array_join(tx.split_list(F.col("html"), "<p>"), "|").alias("paragraphs"),
    )


@query(f"""
SELECT page_id, trim(z[1], '{SPACE}') AS name, TRY_CAST(z[2] AS DOUBLE) AS years
FROM (SELECT page_id, unnest(list_zip(string_split(url, '/'), [CAST(page_id AS VARCHAR), '7', '', '2.5'], true)) AS z FROM pages)
WHERE trim(z[1], '{SPACE}') <> ''
""")
def zip_form_lists(t: Tables) -> DataFrame:
    values = F.array(F.col("page_id").cast("string"), F.lit("7"), F.lit(""), F.lit("2.5"))
    pairs = tx.zip_shortest(F.split("url", "/"), values)
    return t("pages").select("page_id", F.inline(pairs).alias("name", "years"))


@query("""
SELECT doc_id, CASE WHEN lang IN ('de', 'es') THEN 'unknown company' ELSE lang END AS company FROM documents
""")
def display_defaults(t: Tables) -> DataFrame:
    company = F.when(F.col("lang") == "de", "").when(F.col("lang") != "es", F.col("lang"))
    return t("documents").select("doc_id", tx.text_or(company, "unknown company").alias("company"))


@query("""
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4
""")
def history_window(t: Tables) -> DataFrame:
    return reports.recent_messages(t("conversations"), 4)


@query("""
SELECT source, count(*) AS docs FROM documents WHERE lang = 'en' AND n_chars >= 500 GROUP BY source
""")
def bound_parameters(t: Tables) -> DataFrame:
    return query_table(
        t.spark,
        "SELECT source, count(*) AS docs FROM {d} WHERE lang = :lang AND n_chars >= :least GROUP BY source",
        {"lang": "en", "least": 500},
        d=t("documents"),
    )


@query(f"""
SELECT job_id, title, remote, salary_max, salary_max / 2 AS half, posted_at, string_split(tags, ',')[1] AS first_tag,
  len(string_split(tags, ',')) AS n_tags, location, NULL::VARCHAR AS missing
FROM ({CLEAN_SQL})
""")
def payload_read_back(t: Tables) -> DataFrame:
    """Typed values read back out of the stored payload: texts, doubles, booleans, times, nested arrays."""
    rows = cleaning.with_payload(cleaning.clean_listings(raw_documents(t("documents")), "feed"), F.lit("2024-01-01").cast("timestamp"))
    read = rows.select(*tx.json_values(
        F.col("payload"), job_id=("$.job_id", "string"), title=("$.title", "string"), remote=("$.remote", "boolean"),
        salary_max=("$.salary_max", "double"), posted_at=("$.posted_at", "timestamp"), first_tag=("$.tags[0]", "string"),
        tags=("$.tags", "array<string>"), location=("$.location", "string"), missing=("$.nowhere", "string"),
    ))
    return read.withColumns({
        "half": F.col("salary_max") / 2, "posted_at": F.col("posted_at").cast("string"), "n_tags": F.size("tags").cast("long"),
    }).drop("tags")


@query(f"""
WITH {RAW_SQL}, {chunk_sql()}, counts AS (
  SELECT 'fetched' AS step, count(*) AS n FROM raw
  UNION ALL SELECT 'kept', count(DISTINCT id) FROM raw WHERE length(description) > 0
  UNION ALL SELECT 'rejected', 0
  UNION ALL SELECT 'chunked', count(DISTINCT doc_id) FROM pieces
  UNION ALL SELECT 'chunks', count(*) FROM pieces
  UNION ALL SELECT 'chunks again', 0)
SELECT step, n FROM counts
""")
def run_counts(t: Tables) -> DataFrame:
    """Counts that an ingest, an embed run and its repetition report, observed while they write stored tables."""
    folder, at = f"{work_dir(t.spark)}/counts-{uuid.uuid4().hex}", F.lit("2024-01-01").cast("timestamp")
    postings = KeyedTable(t.spark, f"{folder}/postings", schemas.POSTINGS, ["job_id"], parts=4, buckets=8)
    chunks = KeyedTable(t.spark, f"{folder}/chunks", schemas.CHUNKS, ["job_id", "chunk_index"], ["job_id"], parts=4, buckets=8)
    ingested = ingest_listings(postings, raw_documents(t("documents")), "feed", at)
    runs = [embed_new(postings.read(), chunks, at, embed=hashing_embedder(dim=MODEL_DIM)) for _ in range(2)]
    return t.spark.createDataFrame([
        ("fetched", ingested.fetched), ("kept", ingested.kept), ("rejected", ingested.rejected),
        ("chunked", runs[0].postings), ("chunks", runs[0].chunks), ("chunks again", runs[1].chunks),
    ], "step string, n long")


@query(f"""
WITH {RAW_SQL}, {chunk_sql()}
SELECT (SELECT count(*) FROM raw) AS fetched,
  (SELECT count(DISTINCT id) FROM raw WHERE length(description) > 0) AS kept,
  (SELECT count(*) FROM pieces) AS chunks,
  (SELECT count(DISTINCT doc_id) FROM pieces) AS chunked
""")
def run_metrics(t: Tables) -> DataFrame:
    raw = raw_documents(t("documents"))
    kept = cleaning.clean_listings(raw, "feed").select("job_id")
    pieces = chunking.chunk(t("documents"), ["doc_id"], "text")
    per_document = pieces.groupBy("doc_id").agg(F.count("*").alias("n"))
    counted = per_document.agg(F.sum("n").alias("chunks"), F.count("*").alias("chunked"))
    return counted.select(
        raw.agg(F.count("*")).scalar().alias("fetched"),
        kept.agg(F.count("*")).scalar().alias("kept"),
        "chunks",
        "chunked",
    )


def _people(t: Tables) -> DataFrame:
    """Customers as profiles: some without headline or summary."""
    segment = F.col("c_mktsegment")
    return t("customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(segment == "BUILDING", "").otherwise(segment).alias("headline"),
        F.when(segment != "MACHINERY", F.col("c_name")).alias("summary"),
        F.array("c_mktsegment", F.lit("Analyst")).alias("target_roles"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("min_salary"),
        (F.col("c_nationkey") < 10).alias("remote_only"),
    )


def event_skills(t: Tables) -> DataFrame:
    """Event types as skills: years are the number of events; errors have none."""
    return t("events").groupBy("user_id", F.col("event_type").alias("skill_name")).agg(
        F.when(F.col("skill_name") != "error", F.count("*").cast("double")).alias("years_experience")
    )


def _listings(t: Tables) -> DataFrame:
    return t("documents").select(
        F.col("doc_id").alias("job_id"),
        F.col("source").alias("title"),
        F.when(F.col("lang") != "fr", F.col("lang")).alias("company"),
        F.col("text").alias("description"),
        F.array("lang", "source").alias("tags"),
        F.when(F.col("lang") != "es", F.col("lang") == "en").alias("remote"),
        F.col("n_chars").cast("double").alias("salary_min"),
        F.lit(None).cast("double").alias("salary_max"),
    )


def _pairs(t: Tables) -> DataFrame:
    """Every document paired with the customer of the same number."""
    return t("documents").select(F.col("doc_id").alias("user_id"), F.col("doc_id").alias("job_id"))


SKILLS_SQL = """
skills AS (
  SELECT user_id, string_agg(CASE WHEN event_type = 'error' THEN event_type
      ELSE event_type || ' (' || CAST(CAST(n AS DOUBLE) AS VARCHAR) || 'y)' END, ', ' ORDER BY event_type) AS skills
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)
"""
CONTEXT_SQL = f"""
{SKILLS_SQL},
context AS (
  SELECT d.doc_id AS user_id, d.doc_id AS job_id,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS headline,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name END AS summary,
    c_mktsegment || ', Analyst' AS roles,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS min_salary, c_nationkey < 10 AS remote_only,
    skills, source AS title, CASE WHEN lang <> 'fr' THEN lang END AS company, text AS description,
    lang || ', ' || source AS tags, CASE WHEN lang <> 'es' THEN lang = 'en' END AS remote, CAST(n_chars AS DOUBLE) AS salary_min
  FROM documents d LEFT JOIN customer ON c_custkey = d.doc_id LEFT JOIN skills k ON k.user_id = d.doc_id)
"""


def _or(col: str, default: str) -> str:
    return f"coalesce(nullif({col}, ''), '{default}')"


_NOT = "not specified"


@query(f"WITH {SKILLS_SQL} SELECT * FROM skills")
def skill_lists(t: Tables) -> DataFrame:
    return reports.skill_lists(event_skills(t))


@query("""
SELECT event_type AS skill_name, CASE WHEN event_type <> 'error' THEN CAST(count(*) AS DOUBLE) ELSE -1 END AS years,
  row_number() OVER (ORDER BY event_type) AS place
FROM events WHERE user_id = 7 GROUP BY event_type
""")
def skills_of_user(t: Tables) -> DataFrame:
    """One user's skills by name."""
    rows = reports.skills_of(event_skills(t), 7).coalesce(1)
    return rows.select(
        "skill_name", F.coalesce("years_experience", F.lit(-1.0)).alias("years"), (F.monotonically_increasing_id() + 1).alias("place")
    )


@query("""
SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS headline
FROM customer WHERE c_custkey = 7
""")
def profile_of_user(t: Tables) -> DataFrame:
    return reports.profile_of(_people(t), 7).select("user_id", "headline")


@query(f"""
WITH {CONTEXT_SQL}
SELECT user_id, job_id, concat_ws(chr(10),
  'Headline: ' || {_or('headline', _NOT)}, 'Summary: ' || {_or('summary', _NOT)}, 'Roles wanted: ' || {_or('roles', _NOT)},
  'Skills: ' || {_or('skills', _NOT)}, 'Remote only: ' || coalesce(CAST(remote_only AS VARCHAR), 'none'),
  'Least salary: ' || coalesce(CAST(min_salary AS VARCHAR), 'none'), 'Position: ' || title,
  'Company: ' || {_or('company', 'unknown company')}, 'Remote: ' || coalesce(CAST(remote AS VARCHAR), 'none'),
  'Pay from: ' || CAST(salary_min AS VARCHAR), 'Pay to: none', 'Tags: ' || tags, 'Text: ' || substring(description, 1, 1500))
  || chr(10) || chr(10) || 'Say in a few sentences how well this position fits the person, naming overlaps and gaps.' AS prompt
FROM context
""")
def match_prompts(t: Tables) -> DataFrame:
    context = prompts.match_context(_pairs(t), _people(t), event_skills(t), _listings(t))
    return prompts.match_prompts(context)


DRAFT_SQL = f"""
WITH {CONTEXT_SQL}
SELECT user_id, job_id, CASE WHEN remote THEN 'resume_bullet' ELSE 'cover_letter' END AS kind,
  CASE WHEN remote THEN
    concat_ws(chr(10), 'Summary: ' || coalesce(nullif(summary, ''), {_or('headline', _NOT)}), 'Skills: ' || {_or('skills', _NOT)},
      'Position: ' || title, 'Company: ' || {_or('company', 'unknown company')}, 'Text: ' || substring(description, 1, 1000))
    || chr(10) || chr(10) || 'Write one resume line that fits this position.'
  ELSE
    concat_ws(chr(10), 'Headline: ' || {_or('headline', _NOT)}, 'Summary: ' || {_or('summary', _NOT)}, 'Skills: ' || {_or('skills', _NOT)},
      'Position: ' || title, 'Company: ' || {_or('company', 'unknown company')}, 'Text: ' || substring(description, 1, 1500))
    || chr(10) || chr(10) || 'Write three short paragraphs for a cover letter to this position.' END AS prompt
FROM context
"""


def _drafts(t: Tables) -> DataFrame:
    context = prompts.match_context(_pairs(t), _people(t), event_skills(t), _listings(t))
    return prompts.draft_prompts(context, F.when(F.col("remote"), "resume_bullet"))


@query(DRAFT_SQL)
def draft_prompts(t: Tables) -> DataFrame:
    return _drafts(t)


def _stub_model():
    """Stands in for a model: reports each prompt's length and first line."""
    return lambda texts: [f"{len(text)}|{text.splitlines()[0]}" for text in texts]


@query(f"""
SELECT user_id, job_id, kind, CAST(length(prompt) AS VARCHAR) || '|' || string_split(prompt, chr(10))[1] AS completion
FROM ({DRAFT_SQL})
""")
def batch_completion(t: Tables) -> DataFrame:
    return complete(_drafts(t), _stub_model).drop("prompt")


