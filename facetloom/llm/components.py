"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def are_stars(held: DataFrame) -> bool:
    """Whether each node has one edge down, or edges up only; the roots are then the smallest nodes."""
    ends = held.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(held.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node it reaches.

    Each step joins edges with the minimum of their end's neighbours.  Minima are
    pre-aggregated, and a hub's edges are left to adaptive skew splitting; no
    neighbour list is gathered.  Only counts come to the driver.
    """
    a, b = F.col("a"), F.col("b")
    held = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not are_stars(held):
        both = held.union(held.select(b, a))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct(a.alias("a"), F.col("m").alias("b")))))
        held = cut(small.filter("a <> b").distinct())
    return held.select(a.alias("node"), b.alias("root")).union(held.select(b, b).distinct())
