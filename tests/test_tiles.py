"""Points that meet their leaves of all grids in one shuffle."""

import re

import pytest

from checks import datasets as D
from gridscan.config import Domain, Params
from gridscan.operators import tiles
from gridscan.plans import detect as plan
from gridscan.plans.detect import detect

SCHEMA = "point_id long, batch_id long, ts timestamp, x double, y double"
DOMAIN = Domain(-3, 10, 5, 14)
# Aligned with cells, not aligned, and by less than rounding keeps.
SHIFTS = ((0.0, 0.0), (2.0, 1.0), (0.1, 3.9999999), (7.999999999999999, 1e-17))


def rows_of(spark, params, rows):
    df = spark.createDataFrame([(i, i % 2, None, *row) for i, row in enumerate(rows)], SCHEMA)
    found = detect(df, params).points.collect()
    return sorted((r.point_id, r.batch_id, r.tree, r.node_id, round(r.distance, 9), round(r.score, 9)) for r in found)


def awkward():
    """Edges and corners of cells, points next to them, one place again and again, and points outside."""
    xs = [-3.0, -3.0 + 1e-15, -1.0, -0.9999999999999999, 0.3, 1.0, 4.9, 4.999999999999999, 5.0]
    ys = [10.0, 10.5, 11.0, 11.000000000000002, 12.7, 13.999999999999998, 14.0]
    return [(x, y) for x in xs for y in ys] + [(0.3, 12.7)] * 40 + [(9.0, 11.0), (float("nan"), 11.0), (0.0, -1.0)]


@pytest.mark.parametrize("scorer, depth", [("path", 20), ("path", 2), ("box", 5)])
def test_tiles_change_no_score(spark, monkeypatch, scorer, depth):
    params = Params(trees=4, grids=SHIFTS, domain=DOMAIN, max_depth=depth, neighborhood_size=3, scorer=scorer, alpha=2)
    monkeypatch.setattr(tiles, "TILE_ROWS", 10)  # the place with 40 points is split
    found = rows_of(spark, params, awkward())
    assert len(found) == len(awkward())
    monkeypatch.setattr(plan, "CHAINED", 1)  # a row per point and tree
    assert rows_of(spark, params, awkward()) == found


def test_points_are_never_rows_per_tree_in_a_shuffle(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = detect(D.events(spark, sf_dir), D.FOUR, str(tmp_path)).points._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    placed = [line for line in text.splitlines() if re.search(r"Exchange hashpartitioning\(tile#\d+L, (cast|part)", line)]
    assert len(placed) == 1 + D.FOUR.trees  # the points, and the codes of each tree
    assert all("REPARTITION_BY_COL" in line for line in placed)
    assert text.count("Generate inline") == 1  # for the points outside the domain


def test_a_tile_has_a_bounded_number_of_codes(spark):
    for depth in (3, 8, 16, 20, 30):
        params = Params(trees=2, grids=SHIFTS[:2], domain=DOMAIN, max_depth=depth)
        df = spark.createDataFrame([(0, 0, None, 4.9, 13.9)], SCHEMA)
        (row,) = tiles.add_tiles(df, params).collect()
        last = max((1 << depth) >> 8, 1) - 1
        assert 0.9 * last - 1 <= row.tile >> 32 <= last
