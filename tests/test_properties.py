"""Random and skewed inputs against the plain model; invariants of the trees."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import model
from gridscan.config import Domain, Params
from gridscan.operators import assign, cells, codes, grids, score
from gridscan.plans.detect import detect
from test_golden import points

UNIT = Domain(0, 0, 1, 1)


def skewed(n, seed):
    """A third at one spot, a third in a tight cluster, the rest spread out or outside."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = i % 3
        if kind == 0:
            x, y = 0.3, 0.7
        elif kind == 1:
            x, y = 0.5 + rng.gauss(0, 1e-4), 0.5 + rng.gauss(0, 1e-4)
        else:
            x, y = rng.uniform(-0.05, 1.05), rng.uniform(-0.05, 1.05)
        rows.append((i, 0, 0, x, y))
    return rows


@pytest.mark.parametrize("depth", [1, 5, 8, 9, 17, 30])
@pytest.mark.parametrize("many", [1, 40])
def test_trees_and_scores_equal_the_model(spark, depth, many):
    params = Params(max_depth=depth, neighborhood_size=many, domain=UNIT)
    rows = skewed(600, depth)
    result = detect(points(spark, rows), params)
    coded = {i: model.code(x, y, params) for i, _, _, x, y in rows}
    inside = [c for c in coded.values() if c is not None]
    expected = model.tree(inside, params)
    got = {(r.level, r.cell): (r.n, r.is_leaf) for r in result.cells.collect()}
    assert got == expected
    assert len(got) == 1 + 4 * sum(not leaf for _, leaf in got.values())
    assert sum(n for n, leaf in got.values() if leaf) == len(inside)
    scored = result.points.collect()
    assert len(scored) == len(rows)
    for r in scored:
        c = coded[r.point_id]
        if c is None:
            assert (r.node_id, r.score) == ("-1", 0.0)
        else:
            leaf = model.leaf_of(c, expected, params)
            assert len(r.node_id) == leaf[0] + 1
            assert r.score == pytest.approx(model.leaf_path_score(leaf, expected), abs=1e-9)


def test_located_leaves_equal_counted_leaves(spark):
    params = Params(max_depth=20, neighborhood_size=5, domain=UNIT, trees=3, seed=1)
    coded = grids.code_points(points(spark, skewed(900, 3)), params)
    by_code = codes.code_leaves(codes.code_counts(coded), params)
    tree = cells.build_cells(by_code, params)
    located = codes.locate(codes.code_counts(coded), cells.leaf_cells(tree), params)
    assert sorted(map(tuple, located.collect())) == sorted(map(tuple, by_code.collect()))


def test_hot_codes_are_split_without_changing_results(spark, monkeypatch):
    params = Params(max_depth=12, neighborhood_size=5, domain=UNIT)
    df = points(spark, skewed(900, 4))
    plain = sorted(map(tuple, detect(df, params).points.drop("ts").collect()))
    monkeypatch.setattr(assign, "HOT_ROWS", 10)
    monkeypatch.setattr(assign, "HOT_SHARE", 30)
    coded = grids.code_points(df, params)
    hot = assign.hot_codes(codes.code_counts(coded), params.trees).collect()
    assert 1 <= len(hot) <= 30 and max(r.parts for r in hot) >= 10
    assert sorted(map(tuple, detect(df, params).points.drop("ts").collect())) == plain


def test_partitioning_does_not_matter(spark):
    params = Params(max_depth=12, neighborhood_size=5, domain=UNIT, trees=2, seed=9)
    df = points(spark, skewed(300, 5))
    runs = [sorted(map(tuple, detect(df.repartition(k), params).points.drop("ts").collect())) for k in (1, 7)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("alpha", [1, 2, 6])
def test_box_score_equals_the_definition(spark, alpha):
    params = Params(max_depth=7, neighborhood_size=3, domain=UNIT, alpha=alpha, scorer="box")
    rows = skewed(300, alpha)
    tree = model.tree([c for c in (model.code(x, y, params) for *_, x, y in rows) if c is not None], params)

    def pair(a, leaf, level):
        cj = (a, leaf[1] >> (2 * (leaf[0] - a)))
        own = tree[(level, leaf[1] >> (2 * (leaf[0] - level)))][0]
        under = [
            n for (l, c), (n, is_leaf) in tree.items()
            if l >= a and c >> (2 * (l - a)) == cj[1] and (l == level or (l < level and is_leaf))
        ]
        n, s2, s3 = tree[cj][0], sum(c * c for c in under), sum(c**3 for c in under)
        spread = n * s3 - s2 * s2
        return 0.0 if s2 == n or spread == 0 else (s2 / n - own) / (spread**0.5 / n)

    result = detect(points(spark, rows), params)
    for r in score.score_box(result.cells, params).collect():
        leaf = (r.level, r.cell)
        profile = [pair(a, leaf, min(a + alpha, r.level)) for a in range(r.level + 1)]
        assert r.profile == pytest.approx(profile, abs=1e-9)
        assert r.score == pytest.approx(max(0.0, *profile[: max(0, r.level + 1 - alpha) + 1]), abs=1e-9)


def test_one_grid_gives_the_same_box_score_both_ways(spark):
    """With equal grids, choosing among trees must give the single-tree score."""
    one = Params(max_depth=8, neighborhood_size=3, domain=UNIT, alpha=2, scorer="box")
    two = replace(one, trees=2, grids=((0.0, 0.0), (0.0, 0.0)))
    df = points(spark, skewed(300, 8))
    first = {r.point_id: (r.tree, r.node_id, round(r.score, 9)) for r in detect(df, one).points.collect()}
    second = {r.point_id: (r.tree, r.node_id, round(r.score, 9)) for r in detect(df, two).points.collect()}
    assert first == second


def test_counts_keep_every_cell_on_update(spark):
    params = Params(max_depth=6, neighborhood_size=2, domain=UNIT)
    df = points(spark, skewed(90, 2))
    coded = grids.code_points(df, params)
    tree = cells.build_cells(codes.code_leaves(codes.code_counts(coded), params), params)
    gone = codes.code_counts(coded).withColumn("n", -F.col("n"))
    located = codes.locate(gone, cells.leaf_cells(tree), params)
    emptied = cells.apply_deltas(tree, cells.path_deltas(located))
    assert emptied.where("n != 0").count() == 0 and emptied.count() == tree.count()
    trimmed = cells.trim_cells(emptied, params).collect()
    assert [(r.level, r.n, r.is_leaf) for r in trimmed] == [(0, 0, True)]
