"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) for every node with an edge to another.

    Alternates the large-star and small-star steps of map-reduce connected
    components, O(log n) rounds in practice. Each step is an aggregation with
    map-side combine and a join that Spark splits when a hub is hot. Every
    round is checkpointed; only a count and a checksum reach the driver. Null
    nodes have no edges.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        told = both.join(least, "a")
        if large:
            out = told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = told.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a > b").distinct()

    def mark(e: DataFrame):
        # xor of hashes: no overflow under ANSI, whatever the order of rows
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    seen = mark(now)
    for _ in range(rounds if seen[0] else 0):
        now = cut(step(step(now, True), False))
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
