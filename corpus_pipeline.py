"""From raw documents to packed training windows: five stages, each one an operator of ``trackweave.llm``.

Every stage works on all rows that the one before kept; its result is written
as Parquet to the shared folder and read again, so that a lost executor costs
one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.llm import jaccard_join, packing, quality_rules, secrets, substring_dedup
from trackweave.session import configure, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep every quality rule."""
    return quality_rules.quality_stage(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles."""
    configure(spark)
    return jaccard_join.jaccard_stage(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier already."""
    configure(spark)
    return substring_dedup.substring_stage(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked."""
    return secrets.secrets_stage(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows, ids included."""
    pieces = packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", remove_passages),
    ("secret scans", mask_secrets),
    ("packing", pack_windows),
]

#: Token ids and character models are not SQL; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"stage{number}")
    return docs
