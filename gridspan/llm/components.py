"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst long) -> (node, component), component being the smallest node reachable.

    Only nodes with an edge to another node are returned; nulls and loops are ignored. Each round is written
    to the checkpoint folder; only three numbers a round reach the driver. Minima are pre-aggregated before
    each shuffle, so a node with very many edges does not gather in one task.
    """
    src, dst = F.col("src"), F.col("dst")
    e = edges.where(src.isNotNull() & dst.isNotNull() & (src != dst))
    e = cut(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        new = _mark(e)
        if new == mark:
            break
        mark = new
    lone = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(lone)
