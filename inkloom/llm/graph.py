"""Connected components of an edge table, by alternating star contractions.

Every round rewires the edges of each node to its smallest neighbour, first those to larger
nodes, then those to smaller ones, until nothing changes (logarithmically many rounds). A round is
combinable minima and equi-joins, so a node with any number of edges is never one group in one task's
memory. Each round is written to the shared folder and cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.plans.spread import store


def _state(edges: DataFrame):
    return tuple(edges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)),
    ).first())


def _rewire(pairs: DataFrame) -> DataFrame:
    """For (node, neighbour) rows: every neighbour tied to the node's smallest of all."""
    least = pairs.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("m"))
    return pairs.join(least, "node")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node with an edge; the root is its component's smallest node.

    ``edges`` has bigint columns ``u, v``; loops, repeats, and either direction are fine, rows
    with a null are ignored.
    """
    e = store(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v").distinct())
    state = _state(e)
    while True:
        both = e.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(
            e.select(F.col("v").alias("node"), F.col("u").alias("near")))
        large = _rewire(both).filter("near > node").select(
            F.col("near").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.col("u").alias("node"), F.col("v").alias("near"))
        small = _rewire(down)
        e = store(
            small.filter("near <> m").select(F.col("near").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct())
        before, state = state, _state(e)
        if before == state:
            break
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
