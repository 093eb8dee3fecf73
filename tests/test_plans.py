"""The physical plans are the ones meant: joins, group limits, skew splits, no Python."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import DATA
from trackweave.operators import chunking, cleaning, keyed, prompts, search, tracking
from trackweave.plans.registry import QUERIES

PYTHON = re.compile(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroups")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


__spark_entry__.queries()  # registers all
MODEL_OR_VECTOR = {"batch_completion"} | {n for n in QUERIES if n.startswith(("search", "best_chunk"))}
WRITES = {"profile_matches", "ingest_stream", "stage_fold_stream", "embed_stream", "upsert_stored", "draft_upsert", "stage_fold_state", "stage_rejects_state"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_OR_VECTOR - WRITES))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert not PYTHON.search(text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["search_topk", "search_batch", "search_profiles", "search_filtered"])
def test_search_has_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_native_search_has_no_python(spark):
    assert not PYTHON.search(plan(QUERIES["search_topk_native"](spark, DATA)))


def test_filters_and_columns_reach_the_scan(spark, table):
    text = plan(QUERIES["unembedded"](spark, DATA))
    assert "LeftAnti" in text and "LeftOuter" not in text
    text = plan(QUERIES["stale_list"](spark, DATA))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", text)
    assert "o_orderpriority" not in text
    text = plan(QUERIES["search_filtered"](spark, DATA))
    assert text.count("ReadSchema: struct<vec_id:bigint,embedding:array<float>>") == 1


def test_first_per_key_limits_before_the_shuffle(spark, table):
    text = plan(cleaning.clean_listings(spark.createDataFrame([], "id string, slug string, company string, position string, location string, tags array<string>, description string, url string, date string, salary_min string, salary_max string"), "s"))
    assert text.count("WindowGroupLimit") == 2 or "LocalTableScan" in text
    text = plan(keyed.latest_per_key(table("orders"), ["o_custkey"], ["o_orderkey"]))
    assert text.count("WindowGroupLimit") == 2


def test_fold_is_a_hash_aggregation(spark):
    text = plan(QUERIES["stage_fold"](spark, DATA))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and "Window" not in text


def test_search_aggregates_before_joining(spark):
    text = plan(QUERIES["search_topk"](spark, DATA))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    assert text.index("Join") < text.index("partial_max(similarity")


@pytest.fixture()
def small_skew(spark):
    values = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in values.items():
        spark.conf.set(name, value)
    yield
    for name in values:
        spark.conf.unset(name)


def hot_commands(spark):
    """A third of all commands belong to one pair."""
    i = F.col("id")
    return spark.range(0, 60000, 1, 8).select(
        F.when(i % 3 == 0, 0).otherwise(i % 5000).alias("user_id"),
        F.when(i % 3 == 0, "hot").otherwise((i % 7).cast("string")).alias("job_id"),
        i.alias("seq"), F.timestamp_seconds(i).alias("ts"),
        F.when(i % 2 == 0, "save").otherwise("update").alias("op"),
        F.element_at(F.array(*[F.lit(s) for s in ("saved", "applied", "bogus", "offer")]), (i % 4 + 1).cast("int")).alias("stage"),
        F.lit(0.5).alias("match_score"),
    )


def test_hot_pair_is_split_when_commands_are_judged(spark, small_skew):
    saved = spark.createDataFrame([], "user_id bigint, job_id string")
    judged = tracking.judged_commands(saved, hot_commands(spark))
    text = final_plan(judged)
    assert "skewed" in text or "isSkewJoin=true" in text, text
    assert judged.count() == 60000


def test_hot_user_is_split_in_prompts_and_replacement(spark, small_skew):
    i = F.col("id")
    user = F.when(i % 3 == 0, 0).otherwise(i % 5000).alias("user_id")
    pairs = spark.range(0, 60000, 1, 8).select(user, (i % 40).cast("string").alias("job_id"))
    ids = spark.range(5000).withColumnRenamed("id", "user_id")
    profiles = ids.selectExpr("user_id", "'h' headline", "'s' summary", "array('r') target_roles", "1.0D min_salary", "true remote_only")
    skills = ids.selectExpr("user_id", "'sql' skill_name", "1.0D years_experience")
    postings = spark.range(40).selectExpr(
        "cast(id as string) job_id", "'t' title", "'c' company", "'d' description", "array('x') tags",
        "true remote", "1.0D salary_min", "1.0D salary_max",
    )
    context = prompts.match_context(pairs, profiles, skills, postings)
    assert "skewed" in final_plan(context) and context.count() == 60000
    target = pairs.selectExpr("user_id", "job_id skill_name", "1.0D years")
    owners = spark.range(1, 100).select(F.col("id").alias("user_id")).union(spark.range(50).select("id"))
    kept = keyed.replace_owned(target, owners, target.limit(0), "user_id", "skill_name", ["years"])
    assert "skewed" in final_plan(kept)


def vector_chunks(spark):
    i = F.col("id")
    return spark.range(0, 20000, 1, 8).select(
        F.when(i % 3 == 0, 0).otherwise(i % 500).alias("job_id"), i.cast("int").alias("chunk_index"),
        F.array(i % 7 + 1.0, i % 11 + 1.0).cast("array<float>").alias("embedding"),
    )


def test_hot_posting_is_split_when_filters_join_the_vectors(spark, small_skew):
    postings = spark.range(500).selectExpr("id job_id", "true remote", "1.0D salary_max")
    text = final_plan(search.with_filters(vector_chunks(spark), postings))
    assert "skewed" in text or "isSkewJoin=true" in text


def test_many_queries_shuffle_no_vectors(spark, small_skew):
    stored = vector_chunks(spark).selectExpr("*", "job_id % 2 = 0 remote", "cast(job_id as double) salary_max")
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0], True, 3.0)], "query_id int, embedding array<double>, remote_only boolean, min_salary double"
    )
    found = search.search_many(stored, queries, 3)
    assert not [line for line in plan(found).splitlines() if "Exchange" in line and "embedding" in line]
    assert "Join" not in plan(found) and found.count() == 3


def test_prompts_cut_texts_before_the_joins(spark):
    pairs = spark.createDataFrame([(1, "j")], "user_id bigint, job_id string")
    profiles = pairs.selectExpr("user_id", "'h' headline", "'s' summary", "array('r') target_roles", "1.0D min_salary", "true remote_only")
    skills = pairs.selectExpr("user_id", "'sql' skill_name", "1.0D years_experience")
    postings = spark.range(40).selectExpr(
        "cast(id as string) job_id", "'t' title", "'c' company", "repeat('d', cast(id as int)) description", "array('x') tags",
        "true remote", "1.0D salary_min", "1.0D salary_max",
    )
    lines = prompts.match_context(pairs, profiles, skills, postings)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = next(i for i, line in enumerate(lines) if "substring" in line)
    assert max(i for i, line in enumerate(lines) if "Join" in line) < cut


def test_repeated_keys_do_not_multiply_in_anti_joins(spark):
    rows = spark.range(10).select(F.col("id").alias("k"))
    other = spark.range(0, 30000, 1, 8).select(F.when(F.col("id") % 3 == 0, 1).otherwise(2).cast("bigint").alias("k"))
    text = plan(keyed.not_in(rows, other, ["k"]))
    assert "HashAggregate" in text
    assert keyed.not_in(rows, other, ["k"]).count() == 8


def test_chunking_needs_no_shuffle(spark, table):
    assert "Exchange" not in plan(chunking.chunk(table("documents"), ["doc_id"], "text"))


@pytest.fixture()
def known_and_new(spark, tmp_path):
    """Postings of which every 50th has no chunks, two of them twice, one blank, one without an id."""
    rows = spark.range(0, 20000, 1, 4).selectExpr("cast(id as string) job_id", "repeat(concat('text ', id, ' '), 20) description")
    odd = spark.createDataFrame([("50", "text again"), ("100", "once more"), ("x", "  "), (None, "no id"), (None, " ")], "job_id string, description string")
    rows.union(odd).write.parquet(f"{tmp_path}/postings")
    spark.range(20000).filter("id % 50 > 0").selectExpr("cast(id as string) job_id", "0 chunk_index").write.parquet(f"{tmp_path}/chunks")
    return spark.read.parquet(f"{tmp_path}/postings"), spark.read.parquet(f"{tmp_path}/chunks")


def test_texts_of_known_postings_are_not_shuffled(spark, known_and_new):
    postings, chunks = known_and_new
    want = sorted(map(str, chunking.without_chunks(postings, chunks).collect()))
    found = chunking.fetch_without_chunks(postings, chunks)
    assert sorted(map(str, found.collect())) == want and len(want) == 403
    assert "BroadcastHashJoin" in plan(found) and "hashpartitioning" not in plan(found)
    nothing = chunking.fetch_without_chunks(postings.limit(0), chunks)
    assert nothing.count() == 0 and nothing.columns == postings.columns
    assert chunking.fetch_without_chunks(postings, chunks.limit(0)).count() == 20003


def test_many_new_ids_thin_out_the_texts(spark, known_and_new):
    postings, chunks = known_and_new
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
    }
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        found = chunking.fetch_without_chunks(postings, chunks)
        assert "might_contain" in plan(found) and "SortMergeJoin" in plan(found)
        assert found.count() == 403
    finally:
        for name in small:
            spark.conf.unset(name)
