"""Connected components by alternating large and small stars; nothing reaches the driver but two sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged


def _sum(edges: DataFrame):
    mark = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mark)).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for rows ``a, b``: the smallest node of each component, for all nodes but the roots.

    Loops, repeated and reversed edges are allowed. A node with very many edges is
    summed before the shuffle and joined with one row, so it can be split.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    before, after = None, _sum(now)
    while before != after and after[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = staged(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        before, after = after, _sum(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
