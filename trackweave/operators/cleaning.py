"""Raw listings to canonical postings, and the filters around it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trackweave.functions import text as tx
from trackweave.operators.keyed import latest_per_key


def drop_notices(raw: DataFrame) -> DataFrame:
    """Keep objects with an id; feeds may lead with a legal notice that has none."""
    return raw.filter(tx.has_text(F.col("id")))


def clean_listings(raw: DataFrame, source: str | Column, remote_word: str = "remote") -> DataFrame:
    """Dedupe by id, drop listings without description, derive and rename columns.

    Of repeated ids the newest with a description stays; equal dates are
    decided by a hash of the row, so every run keeps the same one.
    """
    described = drop_notices(raw).filter(tx.has_text(F.col("description")))
    used = [c for c in described.columns if c != "slug"]
    single = latest_per_key(
        described.select(*used),
        ["id"],
        [tx.to_time(F.col("date")).desc_nulls_last(), F.xxhash64(*used)],
    )
    return single.select(
        F.col("id").alias("job_id"),
        (source if isinstance(source, Column) else F.lit(source)).alias("source"),
        F.trim("position").alias("title"),
        "company",
        "location",
        tx.remote_flag(F.col("location"), remote_word).alias("remote"),
        tx.to_number(F.col("salary_min")).alias("salary_min"),
        tx.to_number(F.col("salary_max")).alias("salary_max"),
        F.trim("description").alias("description"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "url",
        tx.to_time(F.col("date")).alias("posted_at"),
    )


def with_payload(postings: DataFrame, as_of: Column) -> DataFrame:
    """Add the provenance JSON of the cleaned row and the sync time."""
    return postings.withColumn("payload", tx.row_json(*postings.columns)).withColumn(
        "synced_at", as_of.cast("timestamp")
    )


def split_untitled(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a missing title rejects its row, not the batch."""
    bad = F.col("title").isNull()
    return postings.filter(~bad), postings.filter(bad).withColumn("reason", F.lit("title is missing"))


def not_junk(
    df: DataFrame,
    vocabulary: Sequence[str],
    min_tags: int = 2,
    min_length: int = 200,
    tags: str = "tags",
    description: str = "description",
    salaries: Sequence[str] = ("salary_min", "salary_max"),
) -> DataFrame:
    """Keep rows with a real salary, or enough known tags and a long description."""
    known = F.array(*[F.lit(word.lower()) for word in sorted(set(vocabulary))])
    lowered = F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.lower)
    tagged = F.size(F.array_intersect(lowered, known)) >= min_tags
    long_enough = F.coalesce(F.length(description) >= min_length, F.lit(False))
    paid = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(c) > 0, F.lit(False)) for c in salaries],
        F.lit(False),
    )
    return df.filter(paid | (tagged & long_enough))


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack sources by column name; ``source`` tells them apart."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
