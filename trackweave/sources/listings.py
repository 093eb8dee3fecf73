"""Raw listing feeds: JSON files in a landing folder, or JSON text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackweave.operators.cleaning import drop_notices
from trackweave.schemas import RAW_LISTING


def impose_schema(raw: DataFrame) -> DataFrame:
    """Missing tags become an empty list; everything else stays text or NULL."""
    return raw.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def read_listings(spark: SparkSession, paths: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Read feed files (one JSON array each, or JSON lines) with the fixed schema.

    Several paths are several feeds. Array files are read by one task each
    (``arrays.read_array_listings`` splits them); JSON lines files are split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.schema(RAW_LISTING).json(paths, multiLine=not lines)
    return impose_schema(drop_notices(raw))


def parse_listings(df: DataFrame, json_col: str) -> DataFrame:
    """The same from a text column with one JSON object per row."""
    parsed = df.select(F.from_json(json_col, RAW_LISTING).alias("_raw")).select("_raw.*")
    return impose_schema(drop_notices(parsed))


def query_table(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL over frames named in braces, with bound named parameters.

    Example: ``query_table(spark, "select * from {p} where source = :s", {"s": "x"}, p=postings)``
    """
    return spark.sql(sql, args=args, **tables)
