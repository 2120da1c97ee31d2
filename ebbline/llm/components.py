"""Connected components by alternating stars, on edges that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import stage


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node reachable.

    Each round lets every node hand its smallest neighbour to its larger
    neighbours (large star) and then to its smaller ones (small star); the
    rounds grow with the logarithm of the longest path.  A node with very many
    neighbours costs one map-side minimum and a join whose partitions can be
    split.  Nulls and loops (u = v) are ignored.  No edges give no rows.
    """
    star = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        name,
    )
    before = None
    while True:
        now = star.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        star = stage(small.select("e.u", "e.v").where("u <> v").distinct(), name)
