"""Connected components by alternating large and small stars, each a groupBy and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import shared_dir


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these. Edges point down (u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph.

    `edges` has columns `u` and `v` (same orderable type; loops and nulls are ignored, repeats and both
    directions are allowed). Returns one row `node`, `component` per node that is not the smallest of its
    component, where `component` is the smallest node reachable; nodes that do not occur are their own
    component. An empty edge table gives an empty result. No step collects more than a count and a checksum;
    the rounds grow with the logarithm of the longest path.
    """
    shared_dir(edges.sparkSession)  # checkpoint() needs it
    now = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or mark.n == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        now = _small_star(_large_star(now)).checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
