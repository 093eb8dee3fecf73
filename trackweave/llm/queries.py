"""The registered queries of the operators; each reads whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.llm import alignment, bpe, decontamination, graph_search, jaccard_join, licenses, packing, quality_classifier, quality_rules, secrets, sharding, substring_dedup, whitening
from trackweave.llm.sql import SQL as ALL_SQL
from trackweave.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Number of shards of op2.
SHARDS = 40


def query(function: Callable[[SparkSession, str], DataFrame]):
    """Register a function of (spark, folder) under its own name, with its SQL where there is one."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(configure(spark), folder.rstrip("/"))

    QUERIES[function.__name__] = run
    if function.__name__ in ALL_SQL:
        SQL[function.__name__] = ALL_SQL[function.__name__]
    return function


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


@query
def op2_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    cut = sharding.byte_shards(documents(spark, folder), SHARDS)
    return cut.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.apply_rules(documents(spark, folder))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(documents(spark, folder))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
        F.round("score", 6).alias("score"),
    )


@query
def op1_hierarchical_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(
        documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "window", "step_group",
    )


@query
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(
        documents(spark, folder), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_suffix_trees(spark: SparkSession, folder: str) -> DataFrame:
    done = substring_dedup.remove_repeats(documents(spark, folder))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = jaccard_join.join_documents(documents(spark, folder))
    return joined.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id")
    )


@query
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = secrets.scan(docs, secrets.train(secrets.samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"),
    )


@query
def op3_pruned_graph_search(spark: SparkSession, folder: str) -> DataFrame:
    return graph_search.nearest(table(spark, folder, "embeddings", "vec_id", "embedding"), every=20, k=20)


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality_classifier.train(docs, table(spark, folder, "labels", "doc_id", "quality"))
    scored = quality_classifier.score(docs, model)
    return scored.select(
        "doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality_classifier.GOOD).cast("int").alias("predicted"),
    )


@query
def op11_cross_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = alignment.align_documents(
        documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    return aligned.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best",
        F.col("count_sum").try_cast("long").alias("count_sum"), "groups_sha256",
    )


@query
def op12_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.scan(documents(spark, folder), table(spark, folder, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    done = whitening.whitened(table(spark, folder, "embeddings", "vec_id", "embedding"))
    return done.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
