"""Points that meet their leaves of all grids in one place.

A tile is a coarse cell of the first grid. Shifting a grid moves a code as a whole, so the points of
a code, in whatever grid, lie in at most two neighbouring tiles per axis. Points are shuffled once
by tile, with the codes that have points there; the grids are then looked up one after the other, and
a point never becomes a row per grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscan.config import Params
from gridscan.functions import geometry as G

TILE_DEPTH = 8  # levels from a tile to the codes: at most about 65,536 codes of a grid in each
TILE_ROWS = 1 << 20  # a tile with more points is split into parts, to each of which its codes are copied
CHAINED = 8  # grids that are looked up in one stage

PLACE = ["tile", "part"]


def add_tiles(points: DataFrame, params: Params) -> DataFrame:
    """Add the ``tile`` of each point, NULL outside the domain."""
    domain, depth = params.domain, params.max_depth
    sx, sy = params.shifts()[0]
    u = G.torus_offset(F.col("x"), domain.x_min, domain.width, F.lit(sx))
    v = G.torus_offset(F.col("y"), domain.y_min, domain.height, F.lit(sy))
    column = F.shiftright(G.lattice_index(u, domain.width, depth), TILE_DEPTH)
    row = F.shiftright(G.lattice_index(v, domain.height, depth), TILE_DEPTH)
    inside = G.in_domain(F.col("x"), F.col("y"), domain)
    return points.withColumn("tile", F.when(inside, _packed(column, row)))


def _packed(column: Column, row: Column) -> Column:
    return F.shiftleft(column, 32).bitwiseOR(row)


def _column(tile: Column) -> Column:
    return F.shiftright(tile, 32)


def _row(tile: Column) -> Column:
    return tile.bitwiseAND(F.lit((1 << 32) - 1))


def tile_corners() -> Column:
    """Aggregate: the first and the last tile column and row of a code's points, as two tiles."""
    column, row = _column(F.col("tile")), _row(F.col("tile"))
    low, high = _packed(F.min(column), F.min(row)), _packed(F.max(column), F.max(row))
    return F.struct(low.alias("low"), high.alias("high"))


def _tiles_of(corners: Column) -> Column:
    """The tiles a code may have points in: at most two columns by two rows."""
    low, high = corners["low"], corners["high"]
    every = [_packed(_column(x), _row(y)) for x in (low, high) for y in (low, high)]
    return F.when(low == high, F.array(low)).otherwise(F.array_distinct(F.array(*every)))


def hot_tiles(points: DataFrame) -> DataFrame:
    """Tiles with very many points and their number of parts; fewer rows than one per million points."""
    counts = points.where(F.col("tile").isNotNull()).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("parts")
    return counts.where(F.col("n") > TILE_ROWS).select("tile", parts)


def place_points(points: DataFrame, hot: DataFrame) -> DataFrame:
    """Shuffle the points inside the domain by tile and, of a hot tile, part."""
    parts = F.coalesce(F.col("parts"), F.lit(1))
    part = F.pmod(F.xxhash64("batch_id", "point_id"), parts).cast("int")
    rows = points.where(F.col("tile").isNotNull()).join(F.broadcast(hot), "tile", "left")
    return rows.repartition("tile", part).withColumn("part", part).drop("parts")


def place_codes(codes: DataFrame, hot: DataFrame) -> DataFrame:
    """Shuffle codes with their ``corners`` to the tiles and parts of their points."""
    last = F.coalesce(F.col("parts"), F.lit(1)) - 1
    return (
        codes.withColumn("tile", F.explode(_tiles_of(F.col("corners"))))
        .join(F.broadcast(hot), "tile", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), last)))
        .drop("corners", "parts")
        .repartition(*PLACE)
    )
