"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are put in one global order by range partitioning. Each range partition
gives one total of bytes and rows; a running sum over these totals (one row
per partition, never per document) gives every partition its offset, and a
running sum inside the partition gives every row its place in the whole. A row
belongs to the shard in whose equal share of all bytes its middle byte falls,
so shards are contiguous in the order and differ by less than one document.

Only ids, sizes and check sums are shuffled; texts are read once, by the scan.
The order is (id, check sum, size), with a spreading number after it, so that
an id that holds a third of all rows is cut over many partitions. Rows equal
in all of these are interchangeable.

Defined cases: a NULL text has no bytes and check sum NULL; a NULL id comes
first; an empty table gives no rows; of further columns nothing is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trackweave.session import materialize

#: Bytes that every document costs besides its text.
OVERHEAD = 16
ORDER = ("id", "crc", "size", "spread")


def sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size in bytes and check sum of each document."""
    raw = F.col(text).cast("binary")
    return docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("crc"),
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_prefixes(sized: DataFrame) -> DataFrame:
    """Add ``bytes_before`` and ``rows_before``, counted over the whole table in ``ORDER``."""
    spark, sized = sized.sparkSession, materialize(sized, "sizes")  # the sampling for the ranges reads no texts
    spread = F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(1 << 20))
    ranged = sized.withColumn("spread", spread).repartitionByRange(shuffle_partitions(spark), *ORDER)
    # Stored once: both passes below then see the same rows in the same partitions, also after a lost executor.
    stored = materialize(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    totals = stored.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("part_rows"),
    )
    inside = Window.partitionBy("part").orderBy(*ORDER)
    placed = stored.withColumns({
        "row": F.row_number().over(inside),
        "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    return placed.join(offsets, "part").select(
        "id", "size", "crc",
        (F.col("part_bytes") + F.col("upto") - F.col("size")).alias("bytes_before"),
        (F.col("part_rows") + F.col("row") - 1).alias("rows_before"),
    )


def shard_of(bytes_before: Column, size: Column, total: Column, shards: int) -> Column:
    """The shard in whose share of all bytes the middle of the row falls."""
    middle = bytes_before * 2 + size
    return F.least(F.floor(middle * shards / (total * 2)), F.lit(shards - 1)).cast("int")


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, crc, shard and slot (gapless from 0 in each shard) of every document."""
    placed = materialize(with_prefixes(sizes(docs, id_col, text)), "prefixes")
    total = placed.agg(F.max(F.col("bytes_before") + F.col("size"))).scalar()
    cut = placed.withColumn("shard", shard_of(F.col("bytes_before"), F.col("size"), total, shards))
    firsts = cut.groupBy("shard").agg(F.min("rows_before").alias("first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "id", "size", "crc", "shard", (F.col("rows_before") - F.col("first")).alias("slot")
    )
