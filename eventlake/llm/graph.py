"""Connected components by alternating star contraction, all of it joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crowd, join_crowded, written


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Ties each larger neighbour of a node to the smallest node that the node knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    tied = join_crowded(both, least, ["a"], F.col("n") > most)
    return tied.where("b > a").select(F.col("b").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = join_crowded(down, least, ["u"], F.col("n") > most).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return tied.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: nobody has two parents, or is a parent and has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("child")).union(edges.select("b", F.lit(1)))
    return ends.groupBy("node").agg(F.sum("child").alias("parents"), F.min("child").alias("least")).where("parents > 1 or parents = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); the component is its smallest node.

    Nulls and loops link nothing and give no row; repeated edges count once; no
    edges give no rows. Every round writes its edges, so no lineage builds up.
    The smallest neighbour of a node with very many links is broadcast to them;
    there are at most two thousand such nodes.
    """
    now = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    most = crowd(now.count(), 256)
    settled = False
    while not settled:
        now = written(_small_star(written(_large_star(now, most), "edges"), most), "edges")
        settled = _settled(now)
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component")).distinct()
