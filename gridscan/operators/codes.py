"""Counts of codes and of their prefixes, and the leaf of every code.

A tree is a pure function of the points in the window: a cell is internal exactly if it
holds more than N points and lies above the depth limit. So the leaf level of a code is
the number of its prefixes with more than N points, and no tree has to be walked.

Prefix counts are computed in bands of eight levels. Codes are counted first (with
map-side combine, so repeated coordinates collapse before any shuffle); a band then
groups cells by their ancestor eight levels up. Such a group has at most 4^8 = 65,536
distinct cells whatever the data looks like, which bounds every sort and window below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscan.config import Params
from gridscan.functions import geometry as G
from gridscan.operators.tiles import tile_corners

BAND = 8


def band_edges(depth: int) -> list[tuple[int, int]]:
    """(upper, lower) level of each band, root band first."""
    return [(high, min(high + BAND, depth)) for high in range(0, depth, BAND)]


def code_counts(coded: DataFrame) -> DataFrame:
    """Points per (tree, code); points outside the domain do not count.

    Of points with their ``tile``, also the ``corners`` of each code's tiles.
    """
    corners = [tile_corners().alias("corners")] if "tile" in coded.columns else []
    counts = coded.where("in_domain").groupBy("tree", "code")
    return counts.agg(F.count(F.lit(1)).alias("n"), *corners)


def cell_counts(codes: DataFrame, params: Params) -> DataFrame:
    """Points per (tree, level, cell) for every prefix of every code."""
    depth = params.max_depth
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    return (
        codes.select("tree", "code", "n", levels)
        .groupBy("tree", "level", G.cell_at(F.col("code"), depth, F.col("level")).alias("cell"))
        .agg(F.sum("n").alias("n"))
    )


def _rolled_up(cells: DataFrame, levels_up: int) -> DataFrame:
    parent = F.call_function("shiftright", F.col("code"), F.lit(2 * levels_up))
    return cells.groupBy("tree", parent.alias("code")).agg(F.sum("n").alias("n"))


def _internal_levels(cells: DataFrame, high: int, low: int, params: Params) -> DataFrame:
    """Add ``top``, the ancestor at level ``high``, and ``deep``: how many prefixes of a cell
    at levels high+1..low hold more than N points. The root band also counts level 0.

    In code order, the cells of a prefix are one run. Its count is the running total at the
    run's end less the total before its start. Both totals only grow along the order, so a
    running maximum hands the starts forwards and a running minimum the ends backwards.
    """
    levels = range(high + 1 if high else 0, low)
    group = "PARTITION BY top, tree ORDER BY code"
    forwards = f"({group} ROWS UNBOUNDED PRECEDING)"
    backwards = f"({group} DESC ROWS UNBOUNDED PRECEDING)"
    far = (1 << 63) - 1

    def differs(bits: str, level: int) -> str:
        """The neighbour with these differing bits lies in another cell of the level."""
        return f"{bits} >= {1 << (2 * (low - level))}L"

    totals = (
        cells.selectExpr("*", f"shiftright(code, {2 * (low - high)}) AS top")
        .repartition("tree", "top")
        .selectExpr(
            "*",
            f"sum(n) OVER {forwards} AS _upto",
            f"coalesce(code ^ lag(code) OVER ({group}), {far}L) AS _before",
            f"coalesce(code ^ lead(code) OVER ({group}), {far}L) AS _after",
        )
    )
    starts = totals.selectExpr(
        "*",
        *[
            f"max(CASE WHEN {differs('_before', level)} THEN _upto - n END) OVER {forwards} AS _s{level}"
            for level in levels
        ],
    )
    ends = starts.selectExpr(
        "*",
        *[
            f"min(CASE WHEN {differs('_after', level)} THEN _upto END) OVER {backwards} AS _e{level}"
            for level in levels
        ],
    )
    counts = ["n", *[f"_e{level} - _s{level}" for level in levels]]
    deep = " + ".join(f"int({count} > {params.neighborhood_size})" for count in counts)
    return ends.selectExpr(*cells.columns, "top", f"{deep} AS deep")


def code_leaves(codes: DataFrame, params: Params) -> DataFrame:
    """Add to each code its ``leaf_level`` and ``leaf_cell`` in the tree of these codes.

    Further columns of ``codes`` are passed through.
    """
    edges = band_edges(params.max_depth)
    weights = [codes]
    for high, low in reversed(edges[1:]):
        weights.append(_rolled_up(weights[-1], low - high))
    weights.reverse()

    def band(i: int) -> DataFrame:
        high, low = edges[i]
        rows = _internal_levels(weights[i], high, low, params)
        if i == 0:
            return rows.drop("top")
        above = band(i - 1).select("tree", F.col("code").alias("top"), F.col("deep").alias("above"))
        joined = rows.join(above, ["tree", "top"])
        return joined.withColumn("deep", F.col("deep") + F.col("above")).drop("top", "above")

    depth = params.max_depth
    leaf = F.least(F.col("deep"), F.lit(depth))
    return band(len(edges) - 1).select(
        *codes.columns,
        leaf.alias("leaf_level"),
        G.cell_at(F.col("code"), depth, leaf).alias("leaf_cell"),
    )


def locate(codes: DataFrame, leaves: DataFrame, params: Params, carry: tuple[str, ...] = ()) -> DataFrame:
    """Find the leaf of each code in a given tree; adds ``leaf_level`` and ``leaf_cell``.

    Leaves tile the code range, so the leaf of a code is the last leaf that starts at or
    before it. This as-of lookup runs inside the same bounded groups as the counts; codes
    without a leaf inside their group look their group's cell up one band higher.
    ``carry`` names further leaf columns to hand to the codes.
    """
    depth = params.max_depth
    leaf_columns = ["level", *carry]
    found = _locate_band(
        codes.select("tree", "code").distinct(), leaves, band_edges(depth), leaf_columns
    )
    return codes.join(found, ["tree", "code"]).select(
        *codes.columns,
        F.col("leaf.level").alias("leaf_level"),
        G.cell_at(F.col("code"), depth, F.col("leaf.level")).alias("leaf_cell"),
        *[F.col("leaf")[c].alias(c) for c in carry],
    )


def _locate_band(
    keys: DataFrame, leaves: DataFrame, edges: list[tuple[int, int]], leaf_columns: list[str]
) -> DataFrame:
    high, low = edges[-1]
    in_band = (F.col("level") <= low) & ((F.col("level") > high) | F.lit(high == 0))
    near = leaves.where(in_band).select(
        "tree",
        G.first_code(F.col("cell"), low, F.col("level")).alias("code"),
        F.struct(*leaf_columns).alias("leaf"),
    )
    marked = near.unionByName(keys, allowMissingColumns=True)
    top = F.call_function("shiftright", F.col("code"), F.lit(2 * (low - high)))
    upto = (
        Window.partitionBy("tree", "top")
        .orderBy("code", F.col("leaf").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        marked.withColumn("top", top)
        .withColumn("found", F.last("leaf", ignorenulls=True).over(upto))
        .where(F.col("leaf").isNull())
        .select("tree", "code", "top", F.col("found").alias("leaf"))
    )
    if high == 0:
        return placed.drop("top")
    tops = placed.where(F.col("leaf").isNull()).select("tree", F.col("top").alias("code")).distinct()
    above = _locate_band(tops, leaves, edges[:-1], leaf_columns).select(
        "tree", F.col("code").alias("top"), F.col("leaf").alias("above")
    )
    return placed.join(above, ["tree", "top"], "left").select(
        "tree", "code", F.coalesce("leaf", "above").alias("leaf")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def levels_between(first: Column | int, last: Column) -> Column:
    """Ascending levels first..last, empty if first > last."""
    start = F.lit(first) if isinstance(first, int) else first
    return F.when(start <= last, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))
