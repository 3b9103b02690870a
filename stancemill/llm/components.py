"""Connected components by distributed union-find: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancemill.llm.common import dropped, staged


def _stars(e: DataFrame) -> bool:
    """Whether each left node has one edge, to a node that is no left node."""
    chained = e.join(e.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    twice = e.groupBy("u").count().filter("count > 1").select("u")
    return chained.unionByName(twice).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node of its component.

    Each round aggregates the smallest neighbour of a node and writes it before it is joined back, so that
    Spark can split a node with many neighbours; its edges go to the shared folder. Null ends and loops are
    ignored; no edges give no rows.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "a", "b").filter("a <> b").select("u", "v").distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "edges")
        dropped(e, least)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(large, least)
    out = staged(e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    dropped(e)
    return out
