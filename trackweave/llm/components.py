"""Connected components of an edge table by alternating star contraction, all on Spark.

Each round hooks every node to the smallest node it can see and writes the
edges to the shared folder, so that lineage stays short and lost executors
cost one round at most. Node degrees may be large: minima are aggregated
before the shuffle and the join against them is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackweave.operators.keyed import join_hot
from trackweave.session import forget, materialize


def large_star(edges: DataFrame) -> DataFrame:
    """Hook larger neighbours of a node to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return join_hot(both, least, ["u"], "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Hook a node and its smaller neighbours to the smallest of them. Edges come as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = join_hot(edges, least, ["u"], "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) to (node, component), the smallest node of each component; only nodes with edges.

    The result is stored; what the rounds stored is deleted as they go on.
    """
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(down, "edges"), None
    while True:
        last, edges = edges, materialize(small_star(large_star(edges).distinct()).distinct(), "edges")
        forget(last)
        # Stable once the edges are stars: compared by count and sums of hashes, one row.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.hash("v", "u"))).first())
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    named = materialize(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "stars")
    forget(edges)
    return named
