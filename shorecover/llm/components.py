"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Columns node, root for each linked node: root is the smallest node reachable.

    Alternating large and small stars: each round links neighbours to the smallest node they
    see, with the minimum taken by a partial aggregate, so a node of many links is no single
    task. Each round is a written table; about log2(diameter) rounds. Links that are stars are
    done, so no round runs only to see that nothing changes.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node is linked to one smaller node, or to larger ones alone. edges: u > v, distinct."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    return ends.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("least")).where("n > 1 or n = 1 and least = 0").isEmpty()
