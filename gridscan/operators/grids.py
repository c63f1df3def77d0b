"""Grids and the mapping of points to cell codes in every grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscan.config import Params
from gridscan.functions import geometry as G

def shift_points(points: DataFrame, params: Params) -> DataFrame:
    """Repeat each point per tree with its shifted offsets ``u``, ``v`` from the lower bounds.

    The shifts are literals of the plan (at most ``MAX_TREES``), so this is a narrow step
    without any join. Points outside the domain keep NULL offsets.
    """
    domain = params.domain
    grids = F.array(
        *[
            F.struct(F.lit(tree).alias("tree"), F.lit(sx).alias("sx"), F.lit(sy).alias("sy"))
            for tree, (sx, sy) in enumerate(params.shifts())
        ]
    )
    inside = F.col("in_domain")
    repeated = points.withColumn(
        "in_domain", G.in_domain(F.col("x"), F.col("y"), domain)
    ).select("*", F.inline(grids))
    u = G.torus_offset(F.col("x"), domain.x_min, domain.width, F.col("sx"))
    v = G.torus_offset(F.col("y"), domain.y_min, domain.height, F.col("sy"))
    return repeated.select(
        *points.columns,
        "tree",
        "in_domain",
        F.when(inside, u).alias("u"),
        F.when(inside, v).alias("v"),
    )


def add_indices(shifted: DataFrame, params: Params) -> DataFrame:
    """Add the lattice indices ``ix``, ``iy`` at the deepest level from ``u``, ``v``."""
    domain, depth = params.domain, params.max_depth
    return shifted.withColumns(
        {
            "ix": G.lattice_index(F.col("u"), domain.width, depth),
            "iy": G.lattice_index(F.col("v"), domain.height, depth),
        }
    )


def code_points(points: DataFrame, params: Params) -> DataFrame:
    """Repeat each point per tree with its ``code`` at the deepest level, NULL outside."""
    coded = add_indices(shift_points(points, params), params)
    code = G.morton(F.col("ix"), F.col("iy"), params.max_depth)
    return coded.select(*points.columns, "tree", "in_domain", code.alias("code"))


def code_points_in(points: DataFrame, tree: int, params: Params) -> DataFrame:
    """Add ``u``, ``v``, ``ix``, ``iy`` and ``code`` of points inside the domain in one grid.

    Only a code that cannot be NULL spares a join the test, which Spark would make on the whole expression.
    """
    domain, (sx, sy) = params.domain, params.shifts()[tree]
    offsets = {
        "u": G.torus_offset(F.col("x"), domain.x_min, domain.width, F.lit(sx)),
        "v": G.torus_offset(F.col("y"), domain.y_min, domain.height, F.lit(sy)),
    }
    rows = add_indices(points.withColumns(offsets), params)
    code = G.morton(F.col("ix"), F.col("iy"), params.max_depth)
    return rows.withColumn("code", F.coalesce(code, F.lit(-1).cast("long")))


def add_offsets(coded: DataFrame, params: Params) -> DataFrame:
    """Restore ``u``, ``v``, ``ix``, ``iy`` of coded points inside the domain.

    Recomputing four numbers after a shuffle is cheaper than shuffling them.
    """
    domain = params.domain
    shifts = F.array(
        *[F.struct(F.lit(sx).alias("sx"), F.lit(sy).alias("sy")) for sx, sy in params.shifts()]
    )
    shift = F.get(shifts, F.col("tree"))
    offsets = {
        "u": G.torus_offset(F.col("x"), domain.x_min, domain.width, shift["sx"]),
        "v": G.torus_offset(F.col("y"), domain.y_min, domain.height, shift["sy"]),
    }
    return add_indices(coded.withColumns(offsets), params)
