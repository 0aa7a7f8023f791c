"""Connected components of an edge table by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every node of ``edges(u, v)`` that isn't its component's smallest, and that smallest node.

    Every step is written to the checkpoint folder, so a lost executor costs one step; the loop ends when a step changes
    nothing. No group of edges is gathered: minima are pre-aggregated and hot nodes sit in joins that Spark can split.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = mark(edges)
    while now[0]:
        edges = durable(_small_star(_large_star(edges)))
        before, now = now, mark(edges)
        if before == now:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
