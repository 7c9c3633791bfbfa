"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
    least = least.select("at", F.least("at", "m").alias("m"))
    # Links go from larger to smaller, so the neighbours above a node are the ends of links that come to it.
    return links.join(least, F.col("v") == F.col("at")).select("u", F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its neighbours below move to the least of these. Links go from larger to smaller."""
    least = links.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
    moved = links.join(least, F.col("u") == F.col("at")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def _is_settled(links: DataFrame) -> bool:
    """Whether every node of distinct links has one link down at most, and none if a link comes to it: then v is u's root."""
    ends = links.select(F.col("u").alias("at"), F.lit(1).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("at"), F.lit(0).alias("down")))
    nodes = ends.groupBy("at").agg(F.sum("down").alias("links"), F.min("down").alias("least"))
    return not nodes.where("links > 1 or links = 1 and least = 0").count()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of links (a, b) that is not its own root.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain. The table of links
    never leaves the executors.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(links.where("a <> b").select(u, v).distinct(), "links")
    while not _is_settled(now):
        now = written(_small_star(_large_star(now)), "links", done=[now])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
