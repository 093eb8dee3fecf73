"""A bit table of bounded size that tells most rows without a partner before they are shuffled for a join.

Rows that pass may still have no partner; rows that do not pass have none. The
table has 16 bits per key up to ``CAP`` bits (1,048,576 rows of two longs, so
its broadcast is bounded); beyond that more rows pass, and the join's result
stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS_PER_KEY = 16
CAP = 1 << 26


def flag_partners(rows: DataFrame, row_key: Column, keys: DataFrame, key: Column, flag: str) -> DataFrame:
    """Add a boolean: false where no row of ``keys`` has the same 64-bit key."""
    bits = min(CAP, 1 << max(10, (BITS_PER_KEY * keys.count()).bit_length()))
    own_bit = F.expr("shiftleft(1L, cast(_place & 63 AS int))")
    table = keys.select(F.pmod(key, F.lit(bits)).alias("_place")).select(
        F.shiftright("_place", 6).alias("_word"), own_bit.alias("_bit")
    ).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    placed = rows.withColumn("_place", F.pmod(row_key, F.lit(bits))).withColumn("_word", F.shiftright("_place", 6))
    joined = placed.join(F.broadcast(table), "_word", "left")
    hit = F.coalesce(F.col("_bits"), F.lit(0).cast("long")).bitwiseAND(own_bit) != 0
    return joined.withColumn(flag, hit).drop("_place", "_word", "_bits")
