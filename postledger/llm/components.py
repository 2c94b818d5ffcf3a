"""Connected components of a list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postledger.shared import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over rows u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with a link to another; root is the component's smallest node.

    Alternating star contraction: nodes hang themselves under the smallest node among
    their neighbours until every tree is a star, in rounds that grow with the
    logarithm of the longest path. Every step is an aggregate or an equi-join, which
    combine or split heavy nodes, and the links are written out between rounds. The
    driver sees a count and a checksum per round.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    before = None
    while True:
        edges = cut(edges, "links")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if state == before or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, edges = state, _stars(edges)
