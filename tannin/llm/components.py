"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tannin.sources import sinks


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node of the component of every node that has an edge.

    Large-star and small-star steps in turn (Kiveris et al., 2014) on stored tables, until
    every node points at the smallest of its component.  The minimum of a node's
    neighbours is summed up before the shuffle and joined back, so the star of a node with
    many edges can be split.  Result: node, root.
    """
    links = sinks.materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u > v").distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u > v").distinct()
        large = sinks.materialize(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(lowest.select("u", F.col("m").alias("v"))).distinct()
        small = sinks.materialize(small)
        # done when each node points at one node, and that at none
        stars = small.groupBy("u").count().filter("count > 1").isEmpty() and \
            small.join(small.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        links = small
        if stars:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
