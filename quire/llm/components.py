"""Connected components of a link table, by large and small stars.

Each round points the neighbours of a node at the least of them, first upwards
(large star), then downwards (small star); the links end as one star per
component, after a number of rounds that grows with the logarithm of the
longest path. A node's least neighbour is a partial aggregate, so a hub's
neighbours are never gathered; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has a parent."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``: the least
    node that it can reach. Self links and repeated links do no harm."""
    # u > v throughout
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "components")
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = materialize(small.filter("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "components")
    stars = edges.select("u", F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(roots)
