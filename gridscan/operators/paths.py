"""Values along the path from the root to each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscan.config import Params
from gridscan.functions import geometry as G
from gridscan.operators.codes import band_edges, union_all


def along_path(cells: DataFrame, value: str, name: str, params: Params) -> DataFrame:
    """Add the array ``name`` of the values of a cell's ancestors and itself, root first.

    ``cells`` holds whole trees. In depth-first order the last cell seen at a coarser level
    is the ancestor there, so one running window per band yields all its levels; the bands
    keep each window group to a bounded number of cells.
    """
    done: list[DataFrame] = []
    for high, low in band_edges(params.max_depth):
        in_band = (F.col("level") <= low) & ((F.col("level") > high) | F.lit(high == 0))
        base = high + 1 if high else 0
        start = G.first_code(F.col("cell"), low, F.col("level"))
        rows = cells.where(in_band).withColumns(
            {"_start": start, "top": F.call_function("shiftright", start, F.lit(2 * (low - high)))}
        )
        before = "(PARTITION BY tree, top ORDER BY _start, level ROWS UNBOUNDED PRECEDING)"
        # The struct tells a NULL value of an ancestor from other levels' rows.
        seen = [
            F.expr(
                f"last(CASE WHEN level = {k} THEN struct(`{value}` AS v) END, true) OVER {before}.v"
            )
            for k in range(base, low + 1)
        ]
        own = F.slice(F.array(*seen), 1, F.col("level") - base + 1)
        rows = rows.withColumn(name, own)
        if done:
            above = done[-1].where(F.col("level") == high).select(
                "tree", F.col("cell").alias("top"), F.col(name).alias("_above")
            )
            rows = rows.join(above, ["tree", "top"]).withColumn(name, F.concat("_above", name))
        done.append(rows.select(*cells.columns, name))
    return union_all(done)


def path_counts(cells: DataFrame, params: Params) -> DataFrame:
    """Add ``path_counts``: the counts from the root down to each cell itself."""
    return along_path(cells, "n", "path_counts", params)
