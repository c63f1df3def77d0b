"""The whole computation on one window of points, as a batch job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridscan.config import Params
from gridscan.operators.assign import hot_codes
from gridscan.operators.cells import build_cells
from gridscan.operators.codes import code_counts, code_leaves
from gridscan.operators.grids import code_points
from gridscan.operators.score import POINT, score_codes, score_coded, score_leaves, score_placed
from gridscan.operators.tiles import CHAINED, add_tiles, hot_tiles
from gridscan.plans.tables import write_table


@dataclass(frozen=True)
class Detection:
    """Tables of one window: cells, leaf scores and scored points."""

    cells: DataFrame
    leaf_scores: DataFrame
    points: DataFrame


# Bytes of a shuffled partition up to which its rows go into a hash table instead of a sort.
HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
HASHED_BYTES = 64 << 20


def hash_small_joins(spark: SparkSession) -> None:
    """Let joins whose smaller side has bounded partitions spare the sort of the points.

    Spark decides by the partitions' sizes as they are; a join with a larger one is sorted.
    """
    if int(spark.conf.get(HASHED, "0").rstrip("b")) < HASHED_BYTES:
        spark.conf.set(HASHED, str(HASHED_BYTES))


# Both sides of a join that are shuffled by some of its keys, the place, are not shuffled again by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def detect(points: DataFrame, params: Params, workdir: str | None = None) -> Detection:
    """Build the trees over ``points`` and score every point.

    With ``workdir``, a shared folder owned by the caller, the point, count, code, cell and leaf
    score tables are written there, so that nothing is made twice, lost executors do not
    repeat them, and later joins know their sizes. Without it, the result is one lazy plan.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        return df if workdir is None else write_table(df, f"{workdir}/{name}")

    hash_small_joins(points.sparkSession)
    window = points.select(*POINT)
    placed = 1 < params.trees <= CHAINED
    if placed:
        points.sparkSession.conf.set(ALL_KEYS, "false")
        window = add_tiles(window, params)
        # Points of a code are counted together before they are shuffled; a large tile takes several files.
        window = window if workdir is None else window.hint("rebalance", "tile")
    window = cut(window, "points")
    coded = code_points(window, params)
    by_code = cut(code_leaves(cut(code_counts(coded), "counts"), params), "codes")
    cells = cut(build_cells(by_code, params), "cells")
    leaf_scores = cut(score_leaves(cells, params), "leaf_scores")
    by_score = score_codes(by_code, leaf_scores, params)
    if placed:
        scored = score_placed(window, by_score, cut(hot_tiles(window), "hot_tiles"), params)
    else:
        scored = score_coded(coded, by_score, hot_codes(by_code, params.trees), params)
    return Detection(cells, leaf_scores, scored)
