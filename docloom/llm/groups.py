"""Problem 3: one group id for all records linked directly or through others.

Seed-tree pruning. In every round each vertex looks at its neighbourhood's minimum and
tells its neighbours; a vertex that is nobody's minimum leaves the graph and hangs below
the smallest minimum it heard of (the propagation forest). Only minima are linked anew, so
the graph shrinks fast, also along chains. When no edge is left the vertices that never
left are the seeds, and their ids flow down the forest, the last round's leavers first.

Every step is a join or an aggregation with map-side combine; a hub with a third of all
links is an ordinary skewed join key that AQE splits. Round tables go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.tables import Stage


def connected_groups(links: DataFrame, left: str, right: str) -> DataFrame:
    """(member, group): every id on a link between two different ids, with its group's smallest id.

    Null ids and self-links are ignored; repeated and swapped links count once; an empty
    table gives no rows; other columns of ``links`` are not looked at. Ids may be of any
    orderable type.
    """
    stage = Stage(links.sparkSession, "groups")
    a, b = F.col(left), F.col(right)
    pairs = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(a.alias("u"), b.alias("v"))
    graph = stage.put(_both_ways(pairs))
    forest: list[DataFrame] = []
    seeds = None
    while not graph.isEmpty():
        heard = stage.put(_minima(graph))
        best = heard.groupBy("v").agg(F.min("m").alias("p"), F.max(F.col("m") == F.col("v")).alias("stays"))
        best = stage.put(best)
        forest.append(best.where(~F.col("stays")).select(F.col("v").alias("member"), F.col("p").alias("parent")))
        nxt = stage.put(_both_ways(heard.join(best.select("v", "p"), "v").where("m <> p").select(F.col("m").alias("u"), F.col("p").alias("v"))))
        # a vertex that stays and has no edge left is the seed of its tree
        done = stage.put(best.where("stays").select(F.col("v").alias("member")).join(nxt.select(F.col("u").alias("member")).distinct(), "member", "left_anti"))
        seeds = done if seeds is None else seeds.unionByName(done)
        stage.drop(graph)
        stage.drop(heard)
        graph = nxt
    if seeds is None:
        return graph.select(F.col("u").alias("member"), F.col("v").alias("group"))
    known = seeds.select("member", F.col("member").alias("group"))
    for tree in reversed(forest):
        # the parent left in a later round or is a seed, so its group is known by now; only the new level is written
        below = tree.join(known.withColumnRenamed("member", "parent"), "parent").select("member", "group")
        known = known.unionByName(stage.put(below))
    return known


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _minima(graph: DataFrame) -> DataFrame:
    """(v, m): m is the minimum of the closed neighbourhood of v itself or of a neighbour of v."""
    least = graph.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    told = graph.join(least, "u").select("v", "m")
    return told.unionByName(least.select(F.col("u").alias("v"), "m")).distinct()


def match_links(matches: DataFrame) -> DataFrame:
    """The rows of ``matches`` that say two different records are the same."""
    return matches.where(F.col("same_entity")).select("left_id", "right_id")


def match_groups(matches: DataFrame) -> DataFrame:
    """p3_found: entity_id, group_id."""
    return connected_groups(match_links(matches), "left_id", "right_id").select(F.col("member").alias("entity_id"), F.col("group").alias("group_id"))
