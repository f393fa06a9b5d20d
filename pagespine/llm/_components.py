"""Connected components of a large graph by alternating star contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``; root is the smallest node that it is connected with.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest; rounds grow with the
    logarithm of the longest path. Minima are aggregated before the shuffle, so that a node with very many
    neighbours is one row from each task. The edges are written to the shared folder after each round.
    """
    links = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        # large star: larger neighbours of each node go to the smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, "links")
        # done when every node has one link, and no root is linked further
        heads = after.groupBy("u").count().filter("count > 1").limit(1).count()
        if not heads and not after.select(F.col("v").alias("u")).join(after, "u", "left_semi").limit(1).count():
            roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        links = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
