"""The cells of the trees: derived from leaves, or kept up to date by count changes.

``cells`` has one row (tree, level, cell, n, is_leaf) per node, empty ones included: an
internal cell always has all four children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridscan.config import Params
from gridscan.functions import geometry as G
from gridscan.operators.codes import code_leaves, levels_between

NODE = ["tree", "level", "cell"]


def _is_internal(params: Params) -> Column:
    return (F.col("n") > params.neighborhood_size) & (F.col("level") < params.max_depth)


def leaf_counts(codes: DataFrame) -> DataFrame:
    """Points per non-empty leaf, from codes with their leaf."""
    return codes.groupBy(
        "tree", F.col("leaf_level").alias("level"), F.col("leaf_cell").alias("cell")
    ).agg(F.sum("n").alias("n"))


def ancestor_counts(leaves: DataFrame, above: Column | int = 0) -> DataFrame:
    """Counts of all cells on the paths from level ``above`` down to the leaves.

    ``n`` may be a signed change. Aggregated map-side, so the top cells, which lie on every
    path, cost one row per map task.
    """
    levels = F.explode(levels_between(above, F.col("level"))).alias("at")
    return (
        leaves.select("*", levels)
        .groupBy(
            "tree",
            F.col("at").alias("level"),
            G.cell_at(F.col("cell"), F.col("level"), F.col("at")).alias("cell"),
        )
        .agg(F.sum("n").alias("n"))
    )


def _with_children(counts: DataFrame, params: Params) -> DataFrame:
    """Add the empty children of internal cells and mark the leaves."""
    node = F.struct(F.col("level"), F.col("cell"), F.col("n"))
    children = [
        F.struct(
            (F.col("level") + 1).alias("level"),
            (F.col("cell") * 4 + digit).alias("cell"),
            F.lit(0).cast("long").alias("n"),
        )
        for digit in range(4)
    ]
    rows = F.when(_is_internal(params), F.array(node, *children)).otherwise(F.array(node))
    cells = (
        counts.select("tree", F.inline(rows)).groupBy(*NODE).agg(F.sum("n").alias("n"))
    )
    return cells.withColumn("is_leaf", ~_is_internal(params))


def build_cells(codes: DataFrame, params: Params) -> DataFrame:
    """All cells of the trees over these points, from codes with their leaf.

    Every tree has a root, also without points.
    """
    roots = codes.sparkSession.range(params.trees).select(
        F.col("id").cast("int").alias("tree"),
        F.lit(0).alias("level"),
        F.lit(0).cast("long").alias("cell"),
        F.lit(0).cast("long").alias("n"),
    )
    return _with_children(ancestor_counts(leaf_counts(codes)).unionByName(roots), params)


def leaf_cells(cells: DataFrame) -> DataFrame:
    return cells.where("is_leaf")


def cells_on_paths(cells: DataFrame, codes: DataFrame) -> DataFrame:
    """The cells on the paths to the leaves of some codes: all that a path score of those leaves needs."""
    leaves = codes.select("tree", F.col("leaf_level").alias("level"), F.col("leaf_cell").alias("cell"), F.lit(0).alias("n"))
    return cells.join(ancestor_counts(leaves.distinct()).drop("n"), NODE, "left_semi")


def path_deltas(located: DataFrame) -> DataFrame:
    """Count change of each cell from codes with their leaf and signed ``n``."""
    return ancestor_counts(leaf_counts(located))


def apply_deltas(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add signed changes to counts; cells stay listed at count zero.

    With ``is_leaf`` in ``counts``, the flag of each cell is kept.
    """
    flags = [F.max("is_leaf").alias("is_leaf")] if "is_leaf" in counts.columns else []
    return (
        counts.unionByName(deltas, allowMissingColumns=True)
        .groupBy(*NODE)
        .agg(F.sum("n").alias("n"), *flags)
    )


def trim_cells(cells: DataFrame, params: Params) -> DataFrame:
    """Drop every cell below one that no longer holds more than N points.

    Counts never grow downwards, so looking at the parent alone removes whole subtrees in
    one step. The four siblings always exist; their sum is the parent's count.
    """
    siblings = Window.partitionBy("tree", "level", F.call_function("shiftright", F.col("cell"), F.lit(2)))
    return (
        cells.withColumn("_parent", F.sum("n").over(siblings))
        .where((F.col("level") == 0) | (F.col("_parent") > params.neighborhood_size))
        .drop("_parent")
        .withColumn("is_leaf", F.col("is_leaf") | ~_is_internal(params))
    )


def cells_to_split(cells: DataFrame, params: Params) -> DataFrame:
    """Leaves that hold more than N points and may still be divided."""
    return cells.where(F.col("is_leaf") & _is_internal(params))


def codes_inside(codes: DataFrame, cells: DataFrame, params: Params) -> DataFrame:
    """Codes that lie in one of the cells, which do not overlap, with its level as ``old_level``.

    Each code is looked up at every level that a cell has, by an equi-join that needs no other cells.
    """
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # at most MAX_DEPTH + 1
    at = F.explode(F.lit(levels).cast("array<int>")).alias("old_level")
    inner = cells.select("tree", F.col("level").alias("old_level"), F.col("cell").alias("old_cell"))
    keyed = codes.select("tree", "code", "n", at).withColumn(
        "old_cell", G.cell_at(F.col("code"), params.max_depth, F.col("old_level"))
    )
    return keyed.join(inner, ["tree", "old_level", "old_cell"]).drop("old_cell")


def split_cells(cells: DataFrame, codes: DataFrame, params: Params) -> DataFrame:
    """Divide over-full leaves down to their final depth in one step.

    ``codes`` are the codes of the window, or at least those inside over-full leaves. Only codes inside such
    leaves are counted again, below their old leaf.
    """
    regrown = code_leaves(codes_inside(codes, cells_to_split(cells, params), params), params)
    new_leaves = regrown.groupBy(
        "tree",
        F.col("leaf_level").alias("level"),
        F.col("leaf_cell").alias("cell"),
    ).agg(F.sum("n").alias("n"), F.max("old_level").alias("old_level"))
    below = _with_children(
        ancestor_counts(new_leaves, F.col("old_level")), params
    )
    # The old leaves come back as internal cells, with the same count.
    return (
        cells.unionByName(below)
        .groupBy(*NODE)
        .agg(F.max("n").alias("n"), F.min("is_leaf").alias("is_leaf"))
    )
