"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One pass.  large: all neighbours count and the larger ones move to the
    smallest; else a node and its smaller neighbours move to their smallest."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:
        near = edges.unionByName(turned)
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "c")
    met = near.join(least, near.u == least.c)
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the
    component's smallest node, which points to itself.

    Only stars over edges are shuffled; nothing is gathered on the driver but
    one row of counts a round.  Null ends and loops are ignored; an empty edge
    table gives an empty result.
    """
    now = cut(edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct())
    was = None
    while True:
        before, now = now, cut(_stars(_stars(now, True), False))
        drop(before)
        sums = now.select(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if sums == was:
            break
        was = sums
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
