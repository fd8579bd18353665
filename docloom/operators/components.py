"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.tables import Stage


def components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, component (its smallest node) of every node on an edge; null ends are ignored, a
    self-loop makes its node a component.

    Each round links neighbours to the smallest neighbour, first the larger then the smaller
    ones, until every edge is a ray of a star. Minima are combined before the shuffle; a hub
    is a skewed join key that AQE splits.
    """
    stage = Stage(edges.sparkSession, "components")
    raw = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null")
    nodes = raw.select(F.col("a").alias("node")).union(raw.select("b")).distinct()
    rays = stage.put(raw.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = rays.unionByName(rays.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage.put(large.where("a <> b").distinct())
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_low.select("a", F.col("m").alias("b")))
        nxt = stage.put(small.where("a <> b").distinct())
        stage.drop(large)
        stage.drop(rays)
        rays = nxt
        now = rays.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return nodes.join(rays.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
