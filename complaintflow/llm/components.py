"""Connected components by alternating large-star and small-star rounds, each a few joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintflow.llm.shared import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are hung on the smallest of them and itself: the larger ones, or the smaller ones and itself.

    A minimum is taken before the join back, so that the neighbours of one node need not meet in one task.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        hubs = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.filter(F.col("v") > F.col("u")).join(hubs, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # edges point from the larger node u to the smaller v
        hubs = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(hubs, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hubs.select("u", F.col("m").alias("v")))
    out = out.filter(F.col("u") != F.col("v"))
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the undirected ``edges`` (u, v)."""
    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        now = stored(_stars(_stars(now, large=True), large=False))
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(now.select("v", "v").distinct()))
