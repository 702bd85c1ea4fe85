"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    tied = down.join(least, "u")
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the least node that can be reached.

    Rounds grow with the logarithm of the longest path; each is written out, so a lost executor costs no more
    than its own share of a round. Joins and aggregations only. A node with any number of edges is counted map-side; the
    nodes' least neighbours are written before edges are joined with them, so both sides of the join are plain exchanges, and
    adaptive execution splits the hot node's.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
