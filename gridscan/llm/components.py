"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a join and an aggregation over the edges; labels are never gathered on the driver or in one
task, and a node with very many neighbours is reduced by partial minima. Each round is written to the shared
folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscan.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")


def _least(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    return near.where("b > a").join(_least(near), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """a, b: each node that has an edge, with the smallest node of its component."""
    columns = [F.col(c) for c in edges.columns[:2]]
    edges = written(edges.select(*columns).toDF("a", "b").where("a != b").distinct())
    before = None
    while True:
        starred = _large_star(edges).where("a != b").distinct()
        edges = written(_small_star(starred).where("a != b").distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.union(edges.select("b", "b").distinct()).toDF("node", "component")
