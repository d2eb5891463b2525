"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import dropped, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node with the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the smallest of them. Here a > b in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    links = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return links.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the smallest node it can reach.

    Alternates large and small stars until nothing changes, which takes about as many
    rounds as the logarithm of the number of nodes. Each round is written to the shared
    folder. Edges of a node with itself count for nothing; a node with nulls is dropped.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    links, mark = stored(links, "links"), None
    while True:
        seen = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen["n"] == 0 or (seen["n"], seen["x"]) == mark:
            break
        mark = (seen["n"], seen["x"])
        before, links = links, stored(_small_star(_large_star(links)), "links")
        dropped(before)
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
