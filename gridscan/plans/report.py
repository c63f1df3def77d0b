"""Reports over cells and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscan.config import Params
from gridscan.functions import geometry as G
from gridscan.operators.paths import path_counts


def _average_nodes(params: Params) -> Column:
    # Every internal cell has four children and every tree one root.
    return (F.count_if(~F.col("is_leaf")) * 4 + params.trees) / params.trees


def avg_nodes(cells: DataFrame, params: Params) -> DataFrame:
    """Average number of nodes per tree, in one row."""
    return cells.agg(_average_nodes(params).alias("avg_nodes"))


def describe_cells(cells: DataFrame, params: Params) -> DataFrame:
    """Readable listing of all nodes: id, level, count, path counts, children and bounds."""
    bounds = G.cell_bounds(F.col("level"), F.col("cell"), params.domain)
    return path_counts(cells, params).select(
        "tree",
        G.node_id(F.col("level"), F.col("cell")).alias("node_id"),
        "level",
        "n",
        "path_counts",
        (~F.col("is_leaf")).alias("has_children"),
        F.inline(F.array(bounds)),
    )


def batch_metrics(
    window: DataFrame | int, cells: DataFrame, params: Params, batch_id: Column | int, seconds: Column | int
) -> DataFrame:
    """One row: batch, points in the window, average nodes per tree, whole seconds spent.

    ``window`` is the window or the number of its points.
    """
    nodes = avg_nodes(cells, params)
    if isinstance(window, int):
        both = nodes.withColumn("window_count", F.lit(window).cast("long"))
    else:
        # Both sides have exactly one row.
        both = window.agg(F.count(F.lit(1)).alias("window_count")).crossJoin(F.broadcast(nodes))
    return both.select(
        F.lit(batch_id).cast("long").alias("batch_id"),
        "window_count",
        "avg_nodes",
        F.lit(seconds).cast("long").alias("seconds"),
    )
