"""Column expressions of the grid: shifting, cell codes, ids, bounds, distances.

A point's ``code`` interleaves the bits of its lattice indices at the deepest level
(x bit low), so the cell of any coarser level is the code shifted right by two bits
per level, and "point in cell" becomes equality of prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridscan.config import Domain

def _shift_right(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))


def _shift_left(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", value, bits if isinstance(bits, Column) else F.lit(bits))


def in_domain(x: Column, y: Column, domain: Domain) -> Column:
    """Inside the closed domain; NaN and NULL are outside."""
    inside = x.between(domain.x_min, domain.x_max) & y.between(domain.y_min, domain.y_max)
    return F.coalesce(inside, F.lit(False))


def torus_offset(v: Column, low: float, width: float, shift: Column) -> Column:
    """Distance of the shifted coordinate from the lower bound, wrapped at the upper one."""
    u = (v - F.lit(low)) + shift
    return F.when((shift > 0) & (u >= width), u - F.lit(width)).otherwise(u)


def lattice_index(u: Column, width: float, depth: int) -> Column:
    """Index of the cell along one axis at the deepest level; the upper edge is the last cell.

    A NULL offset has a NULL index.
    """
    side = 1 << depth
    index = F.least(F.floor(u / F.lit(width) * F.lit(float(side))), F.lit(side - 1).cast("long"))
    return F.when(u.isNotNull(), index)


def _spread(value: Column, depth: int) -> Column:
    """Move the bits of a number to the even positions, a byte at a time.

    The table of spread bytes is a constant of the plan. Shifting and masking the whole
    number instead repeats it 32 times in the expression, which is too much generated code.
    """
    table = F.lit([int(f"{byte:b}", 4) for byte in range(256)])
    spread = []
    for k in range(0, depth, 8):
        byte = _shift_right(value, k).bitwiseAND(F.lit(255)).cast("int")
        spread.append(_shift_left(F.get(table, byte).cast("long"), 2 * k))
    return reduce(Column.bitwiseOR, spread)


def morton(ix: Column, iy: Column, depth: int) -> Column:
    """Interleave two lattice indices below 2^depth; x takes the even bits."""
    return _spread(ix, depth).bitwiseOR(_shift_left(_spread(iy, depth), 1))


def cell_at(code: Column, depth: int | Column, level: int | Column) -> Column:
    """Cell of ``level`` that contains a code of level ``depth``."""
    bits = (F.lit(depth) - F.lit(level)) * 2
    if isinstance(depth, int) and isinstance(level, int):
        bits = F.lit(2 * (depth - level))
    return _shift_right(code, bits)


def first_code(cell: Column, depth: int | Column, level: int | Column) -> Column:
    """Smallest code of level ``depth`` inside a cell of ``level``."""
    return _shift_left(cell, (F.lit(depth) - F.lit(level)) * 2)


def _base4(level: Column, cell: Column) -> Column:
    return F.call_function("lpad", F.conv(cell.cast("string"), 10, 4), level, F.lit("0"))


def node_id(level: Column, cell: Column) -> Column:
    """Readable id: the root is '0', each level appends its digit 0-3; a prefix is an ancestor."""
    return F.concat(F.lit("0"), _base4(level, cell))


def cell_column(level: Column, cell: Column) -> Column:
    """Lattice index of a cell along x at its own level: the low bit of every base-4 digit."""
    bits = F.translate(F.concat(F.lit("0"), _base4(level, cell)), "0123", "0101")
    return F.conv(bits, 2, 10).cast("long")


def cell_row(level: Column, cell: Column) -> Column:
    """Lattice index of a cell along y at its own level: the high bit of every base-4 digit."""
    bits = F.translate(F.concat(F.lit("0"), _base4(level, cell)), "0123", "0011")
    return F.conv(bits, 2, 10).cast("long")


def cell_size(width: float, level: Column | int) -> Column:
    return F.lit(width) / F.pow(F.lit(2.0), F.lit(level))


def cell_bounds(level: Column, cell: Column, domain: Domain) -> Column:
    """Struct x0, y0, x1, y1 of a cell in the coordinates of its (shifted) grid."""
    w, h = cell_size(domain.width, level), cell_size(domain.height, level)
    x0 = F.lit(domain.x_min) + cell_column(level, cell) * w
    y0 = F.lit(domain.y_min) + cell_row(level, cell) * h
    return F.struct(
        x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1")
    )


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Euclidean distance, written as a root of products so that engines agree bit for bit."""
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def center_distance(
    u: Column, v: Column, ix: Column, iy: Column, level: Column, domain: Domain, depth: int
) -> Column:
    """Distance from a shifted point to the centre of its own cell at ``level``.

    ``u``/``v`` are offsets from the lower domain bounds, ``ix``/``iy`` the lattice
    indices at ``depth``; the cell's index at ``level`` is their prefix.
    """
    bits = F.lit(depth) - level
    half = F.lit(0.5)
    cx = (_shift_right(ix, bits) + half) * cell_size(domain.width, level)
    cy = (_shift_right(iy, bits) + half) * cell_size(domain.height, level)
    return distance(u, v, cx, cy)
