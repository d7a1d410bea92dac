"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.storage import save


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for every node that has a link to another.

    Large and small stars in turn: each round hangs the neighbours of a node on the smallest of them, so paths shrink
    to stars in a logarithmic number of rounds. A hot node is a split join, never one group. Each round is a written table.
    """
    edges = save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        after = save(small.where("a <> b").distinct(), "links")
        # stars: every node has one smaller neighbour, and that one has none
        crooked = after.groupBy("a").count().where("count > 1").select("a").union(after.join(after.select(F.col("a").alias("b")), "b", "left_semi").select("a"))
        edges = after
        if crooked.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
    raise RuntimeError("the components didn't settle")
