"""What the physical plans must and must not contain."""

import re

import pytest

from checks import datasets as D
from checks.queries import all_queries
from gridscan.operators import codes, grids, window
from gridscan.plans.detect import detect


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = ["dedup_batch", "cell_counts", "code_leaves", "build_cells", "path_counts", "score_path", "score_box", "assign_leaf", "nearest_grid"]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_no_products_no_single_partition_windows(spark, sf_dir, name):
    plan = plan_of(all_queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "SinglePartition"):
        assert bad not in plan, bad


def test_scan_reads_only_the_needed_columns(spark, sf_dir):
    plan = plan_of(detect(D.events(spark, sf_dir), D.ONE).cells)
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"user_id:bigint,value:double"}


def test_window_cut_reaches_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "points")
    D.events(spark, sf_dir, 1).write.parquet(path)
    points = spark.read.parquet(path)
    plan = plan_of(window.window_count(points, 100))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(ts,", plan)


def test_each_band_shuffles_once_and_sorts_twice(spark, sf_dir):
    coded = grids.code_points(D.events(spark, sf_dir), D.ONE)
    plan = plan_of(codes._internal_levels(codes.code_counts(coded), 8, 16, D.ONE))
    assert plan.count("REPARTITION_BY_COL") == 1
    assert len(re.findall(r"\bWindow\b", plan)) == 3
    assert len(re.findall(r"\+- \*?\(?\d*\)? ?Sort ", plan)) == 2


def test_points_are_not_shuffled_for_one_tree_after_the_join(spark, sf_dir):
    by_point = re.compile(r"hashpartitioning\([^)]*point_id")
    assert not by_point.search(plan_of(detect(D.events(spark, sf_dir), D.ONE).points))
    assert by_point.search(plan_of(detect(D.events(spark, sf_dir), D.FOUR).points))


def test_rows_of_a_point_are_shuffled_once_to_be_compared(spark, sf_dir):
    plan = plan_of(detect(D.events(spark, sf_dir), D.FOUR).points)
    by_point = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\([^)]*point_id", line)]
    assert len(by_point) == 1
    assert "REPARTITION_BY_COL" in by_point[0]
    assert "lpad" not in plan[plan.index(by_point[0]) :]  # ids are only made for the tree that is chosen


def test_written_points_are_read_in_place_of_their_source(spark, sf_dir, tmp_path):
    source = D.events(spark, sf_dir)
    found = detect(source, D.FOUR, str(tmp_path)).points
    assert "events.parquet" not in plan_of(found)
    assert sorted(found.collect()) == sorted(detect(source, D.FOUR).points.collect())
