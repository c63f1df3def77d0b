"""Joining points to the leaves of their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscan.config import Params
from gridscan.functions import geometry as G
from gridscan.operators.grids import add_offsets

HOT_SHARE = 1 << 16  # a code is hot above trees/65,536 of all points ...
HOT_ROWS = 100_000  # ... and above this many points

OUTSIDE_ID = "-1"  # fixed value: id of points outside the domain


def hot_codes(codes: DataFrame, trees: int) -> DataFrame:
    """Codes with very many points and the number of parts to split each into.

    Fewer than ``HOT_SHARE`` rows over all ``trees`` by construction, so the result may be broadcast.
    """
    totals = codes.groupBy("tree").agg(F.sum("n").alias("total"))
    quota = F.greatest(F.col("total") * trees / HOT_SHARE, F.lit(float(HOT_ROWS)))
    return (
        codes.join(F.broadcast(totals), "tree")
        .where(F.col("n") > quota)
        .select("tree", "code", F.ceil(F.col("n") / quota).cast("int").alias("parts"))
    )


def join_codes(coded: DataFrame, by_code: DataFrame, hot: DataFrame) -> DataFrame:
    """Join points inside the domain to a table with one row per (tree, code).

    The rows of a hot code are spread over its parts, to each of which its code row is
    copied; all other codes have one part. The code leads the keys, as sorts first compare the
    first column.
    """
    parts = F.coalesce(F.col("parts"), F.lit(1))
    points = (
        coded.where("in_domain")
        .join(F.broadcast(hot), ["tree", "code"], "left")
        .withColumn("part", F.pmod(F.xxhash64("batch_id", "point_id"), parts).cast("int"))
        .drop("parts")
    )
    lookup = (
        by_code.join(F.broadcast(hot), ["tree", "code"], "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("parts")
    )
    return points.join(lookup, ["code", "tree", "part"]).drop("part")


def leaf_distance(level: Column, params: Params) -> Column:
    """Distance of a point with offsets to the centre of its cell at ``level``."""
    cols = [F.col(c) for c in ("u", "v", "ix", "iy")]
    return G.center_distance(*cols, level, params.domain, params.max_depth)


def outside_points(coded: DataFrame) -> DataFrame:
    """Points outside the domain: no cell, distance and score zero, in tree 0 only."""
    return coded.where(~F.col("in_domain") & (F.col("tree") == 0)).withColumns(
        {
            "node_id": F.lit(OUTSIDE_ID),
            "distance": F.lit(0.0),
            "score": F.lit(0.0),
        }
    )


def assign_leaf(coded: DataFrame, leaves_by_code: DataFrame, hot: DataFrame, params: Params) -> DataFrame:
    """Give each point its leaf and the distance to the leaf's centre, in every tree."""
    joined = add_offsets(join_codes(coded, leaves_by_code.drop("n"), hot), params)
    return joined.withColumn("distance", leaf_distance(F.col("leaf_level"), params))


def node_at_level(located: DataFrame, level: int) -> DataFrame:
    """Add the deepest cell at or above ``level``: (node_level, node_cell)."""
    node_level = F.least(F.col("leaf_level"), F.lit(level))
    return located.withColumns(
        {
            "node_level": node_level,
            "node_cell": G.cell_at(F.col("leaf_cell"), F.col("leaf_level"), node_level),
        }
    )
