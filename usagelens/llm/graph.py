"""Connected components of link tables, by alternating large and small stars.

Every step is a grouped minimum and an equi-join on nodes; the links are cut to
the shared folder between steps. Nodes need not be numbered densely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import cut

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of links (a, b: bigint)."""
    edges = cut(_downward(links.select("a", "b")))
    for _ in range(MOST_ROUNDS):
        if _are_stars(edges):
            ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return ends.union(edges.select("b", "b").distinct())
        edges = cut(_small_star(_large_star(edges)))
    raise RuntimeError("components did not settle")


def _downward(pairs: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return down.where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link down at most, and what it leads to has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    told = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return told.where("down > 1 or down = 1 and up = 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour, or to itself if that is smaller. Links may repeat."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a")
    return _downward(below.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
