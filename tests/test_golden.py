"""Worked numbers for single expressions and operators."""

import math
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import model
from gridscan.config import Domain, Params
from gridscan.functions import deviation
from gridscan.functions import geometry as G
from gridscan.operators import batch, cells, codes, grids, score, window
from gridscan.operators.paths import path_counts
from gridscan.plans import report
from gridscan.plans.detect import detect
from gridscan.streaming.state import POINT_SCHEMA

PATHS = [
    ([7], 0, 0),
    ([41, 20], 0, 0),
    ([9, 3], 0, 0),
    ([100, 60, 45, 1], 5.822215, 5.807374),
    ([100, 60, 45, 40], 1.119957, 1.122186),
    ([1000, 400, 200, 100, 45, 2], 2.143973, 2.143992),
    ([5, 4, 2], 1.333333, 1.414214),
    ([10_000_000, 9_000_000, 30], 547.722557, 547.722558),
]
START = datetime(2024, 1, 1)


def points(spark, rows):
    """rows: (point_id, batch_id, seconds, x, y)"""
    full = [(i, START + timedelta(seconds=s), float(x), float(y), b) for i, b, s, x, y in rows]
    return spark.createDataFrame(full, POINT_SCHEMA)


@pytest.mark.parametrize("exact", [False, True])
def test_path_score(spark, exact):
    df = spark.createDataFrame([(p,) for p, _, _ in PATHS], "path array<bigint>")
    got = [r[0] for r in df.select(F.round(deviation.path_score(F.col("path"), exact), 6)).collect()]
    assert got == [e if exact else t for _, t, e in PATHS]


def test_path_score_with_huge_counts(spark):
    """All number ranges agree with unbounded integers, also where counts nearly coincide."""
    big = 3_000_000_000_000
    paths = [
        [big, big - 5, big - 9, 40],
        [big, big // 2, big // 3, 12, 3],
        [big] * 20,
        [big, big, big - 1, big - 1],
        [big, big - 1, big - 2, big - 3, big - 4],
        [60_000_000, 59_999_999, 59_999_990, 59_999_900],
        [2**40, 2**39, 2**38, 2**37, 2**36, 2**20, 7],
    ]
    df = spark.createDataFrame([(p,) for p in paths], "path array<bigint>")
    got = [r[0] for r in df.select(deviation.path_score(F.col("path"))).collect()]
    for value, path in zip(got, paths):
        assert value == pytest.approx(model.path_score(path), rel=1e-9, abs=1e-9), path


def test_mdef_norm(spark):
    counts = [30, 25, 5, 1, 0, 20, 19]
    cases = [(100, sum(c**2 for c in counts), sum(c**3 for c in counts), 1)]
    big = [c * 10**11 for c in counts]
    cases.append((sum(big), sum(c**2 for c in big), sum(c**3 for c in big), 10**11))
    sql = " UNION ALL ".join(
        f"SELECT {n}L AS n, {q}BD AS s2, {c}BD AS s3, {k}L AS k" for n, q, c, k in cases
    )
    cast = [F.col(c).cast("decimal(38,0)") for c in ("s2", "s3")]
    got = [r[0] for r in spark.sql(sql).select(deviation.mdef_norm(F.col("n"), *cast, F.col("k"))).collect()]
    # 23.12 expected, 1 counted, spread sqrt(57610 * 100 - 2312^2) / 100 = 6.447139
    assert got == pytest.approx([3.430979, 3.430979], abs=1e-6)


A_TO_E = [(10, 20), (12, 22), (-45, -90), (60, 100), (61, 101)]


def test_small_tree(spark):
    params = Params(neighborhood_size=2)
    result = detect(points(spark, [(i, 0, 0, x, y) for i, (x, y) in enumerate(A_TO_E)]), params)
    listing = {
        r.node_id: r for r in report.describe_cells(result.cells, params).collect()
    }
    assert {k: (r.n, r.has_children) for k, r in listing.items()} == {
        "0": (5, True), "00": (1, False), "01": (0, False), "02": (0, False), "03": (4, True),
        "030": (2, False), "031": (0, False), "032": (0, False), "033": (2, False),
    }
    assert listing["033"].path_counts == [5, 4, 2]
    assert (listing["033"].x0, listing["033"].y0, listing["033"].x1, listing["033"].y1) == (45, 90, 90, 180)
    scores = {r.point_id: (r.node_id, round(r.score, 6)) for r in result.points.collect()}
    assert scores == {0: ("030", 1.333333), 1: ("030", 1.333333), 2: ("00", 0.0), 3: ("033", 1.333333), 4: ("033", 1.333333)}
    far = {r.point_id: r.distance for r in result.points.collect()}
    assert far[3] == pytest.approx(math.dist((60, 100), (67.5, 135)))


def test_edges_of_the_domain(spark):
    params = Params(max_depth=6)
    rows = [(0, 0), (90, 180), (90.1, 0), (0, -181), (math.nan, 0), (-90, -180)]
    coded = grids.code_points(points(spark, [(i, 0, 0, x, y) for i, (x, y) in enumerate(rows)]), params)
    got = {r.point_id: r.code for r in coded.collect()}
    assert got[0] >> 10 == 3 and got[1] == 4**6 - 1 and got[5] == 0
    assert got[2] is None and got[3] is None and got[4] is None
    scored = {r.point_id: r for r in detect(points(spark, [(i, 0, 0, x, y) for i, (x, y) in enumerate(rows)]), params).points.collect()}
    assert len(scored) == len(rows)
    assert {i for i, r in scored.items() if r.node_id == "-1"} == {2, 3, 4}
    assert all(scored[i].score == 0.0 and scored[i].distance == 0.0 for i in (2, 3, 4))


def test_shift_wraps_around(spark):
    params = Params(trees=2, grids=((0.0, 0.0), (45.0, 0.0)))
    shifted = grids.shift_points(points(spark, [(0, 0, 0, 50, 0)]), params)
    assert {r.tree: r.u for r in shifted.collect()} == {0: 140.0, 1: 5.0}


def test_node_ids(spark):
    df = spark.createDataFrame([(0, 0), (1, 3), (3, 6), (3, 0)], "level int, cell bigint")
    got = [r[0] for r in df.select(G.node_id(F.col("level"), F.col("cell"))).collect()]
    assert got == ["0", "03", "0012", "0000"]


def test_duplicates_collapse_within_a_batch_only(spark):
    rows = [(0, 0, 0, 1, 1), (1, 0, 0, 1, 1), (2, 0, 0, 2, 2), (3, 1, 30, 1, 1), (4, 2, 60, 0.0, 1), (5, 2, 60, -0.0, 1)]
    df = points(spark, rows)
    assert sorted(r.point_id for r in batch.dedup_batch(df).collect()) == [0, 2, 3, 4]
    assert sorted((r.batch_id, r.x, r.copies) for r in batch.duplicate_points(df).collect()) == [(0, 1.0, 2), (2, 0.0, 2)]


def test_count_window(spark):
    rows = [(i, i // 3, 30 * (i // 3), 0, i) for i in range(9)]
    kept = [range(0, 3), range(1, 6), range(4, 9)]
    for batches in (1, 2, 3):
        df = points(spark, rows[: 3 * batches])
        ids = sorted(r.point_id for r in window.window_count(df, 5).collect())
        assert ids == list(kept[batches - 1])
        gone = sorted(r.point_id for r in window.expired_count(df, 5).collect())
        assert sorted(ids + gone) == list(range(3 * batches))


@pytest.mark.parametrize("ties", [1, 7, 5000])
def test_count_window_narrows_without_ranking_everything(spark, monkeypatch, ties):
    """With a tiny rank limit, the cut is found by histograms, also inside one timestamp."""
    monkeypatch.setattr(window, "RANK_LIMIT", 10)
    monkeypatch.setattr(window, "BUCKETS", 16)
    rows = [((i * 7919) % 100_003 - 50_000, 0, i // ties, 0, 0) for i in range(3000)]
    df = points(spark, rows).cache()
    order = sorted(((s, p) for p, _, s, _, _ in rows), reverse=True)
    for size in (1, 2, 1234, 2999, 3000, 4000):
        ids = {r.point_id for r in window.window_count(df, size).collect()}
        assert ids == {p for _, p in order[:size]}


def test_time_window(spark):
    df = points(spark, [(0, 0, 40, 0, 0), (1, 0, 41, 0, 0), (2, 0, 100, 0, 0)])
    now = F.lit(START + timedelta(seconds=100))
    assert sorted(r.point_id for r in window.window_time(df, now, 60).collect()) == [1, 2]
    assert [r.point_id for r in window.expired_time(df, now, 60).collect()] == [0]
    assert window.expired_time(df, now, 10_000_000).count() == 0


def test_nearest_tree_wins_and_ties_go_to_the_lowest(spark):
    rows = [(3.0, 0, 0.1), (2.0, 2, 0.7), (2.0, 1, 0.5)]
    df = points(spark, [(0, 0, 0, 1, 1)]).crossJoin(
        spark.createDataFrame(rows, "distance double, tree int, score double")
    ).withColumn("node_id", F.lit("0"))
    best = score.score_points(df, Params(trees=3)).collect()
    assert [(r.tree, r.score) for r in best] == [(1, 0.5)]


@pytest.mark.parametrize(
    "bad",
    [
        {"window_type": "hop"}, {"scorer": "x"}, {"window_size": 0}, {"trees": 0}, {"alpha": 0},
        {"neighborhood_size": 0}, {"max_depth": 0}, {"max_depth": 31}, {"trees": 2, "grids": ((0, 0),)},
        {"grids": ((180.0, 0),)},
    ],
)
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_bad_domain():
    with pytest.raises(ValueError):
        Domain(1, 0, 1, 2)


def test_grids_are_reproducible(spark):
    params = Params(trees=3, seed=5)
    first = params.shifts()
    assert first == params.shifts() == Params(trees=3, seed=5).shifts() != Params(trees=3, seed=6).shifts()
    assert first[0] == (0.0, 0.0) and all(0 <= sx < 180 and 0 <= sy < 360 for sx, sy in first)
    shifted = grids.shift_points(points(spark, [(0, 0, 0, -90, -180)]), params).orderBy("tree").collect()
    assert [(r.u, r.v) for r in shifted] == [pytest.approx((sx, sy)) for sx, sy in first]


def test_empty_window_has_roots(spark):
    params = Params(trees=3)
    coded = grids.code_points(points(spark, [(0, 0, 0, 500, 0)]), params)
    tree = cells.build_cells(codes.code_leaves(codes.code_counts(coded), params), params)
    assert sorted((r.tree, r.level, r.n, r.is_leaf) for r in tree.collect()) == [(t, 0, 0, True) for t in range(3)]
    assert report.avg_nodes(tree, params).first()[0] == 1.0
    assert [r.path_counts for r in path_counts(tree, params).collect()] == [[0]] * 3


@pytest.mark.parametrize("n", [10**5, 5 * 10**7 - 1, 5 * 10**7, 5 * 10**7 + 1, 10**9, 10**12, 10**15])
def test_path_score_is_one_form_at_every_size(spark, n):
    paths = [[n, n // 2, n // 3, 5], [n, n - n // 10, n - n // 5, n - n // 4], [n] * 4, [2 * n, n, n // 7, n // 7, 1]]
    df = spark.createDataFrame([(p,) for p in paths], "path array<bigint>")
    got = [r[0] for r in df.select(deviation.path_score(F.col("path"))).collect()]
    for value, path in zip(got, paths):
        assert value == pytest.approx(model.path_score(path), rel=1e-12, abs=1e-12), path


@pytest.mark.parametrize("unit", [1, 10**3, 10**7, 10**11, 10**13])
def test_frontier_spread_at_every_size(spark, unit):
    """Moments from counts, in the parts that hold them, against exact fractions."""
    for counts, own in (([30, 25, 5, 1, 0, 20, 19], 1), ([7] * 10, 7), ([3, 3, 3, 4], 2)):
        counts, own = [c * unit + (c % 2) * (unit > 1) for c in counts], own * unit
        df = spark.createDataFrame([(c,) for c in counts], "c long")
        c = F.col("c").cast(deviation.COUNT)
        s2 = F.sum((c * c).cast(deviation.WIDE)).cast(deviation.WIDE).alias("s2")
        sums = df.agg(F.sum("c").alias("n"), s2, *deviation.cube_sums(c))
        score_ = deviation.mdef_norm(F.col("n"), F.col("s2"), F.col("s3_low"), F.lit(own), F.col("s3_high"))
        got, whole = sums.select(score_, deviation.whole_cubes(F.col("s3_high"), F.col("s3_low"))).first()
        n, q, k = (sum(x**e for x in counts) for e in (1, 2, 3))
        assert whole is None and k >= 10**38 or int(whole) == k
        variance = Fraction(k, n) - Fraction(q, n) ** 2
        want = float(Fraction(q, n) - own) / math.sqrt(variance) if variance > 0 else 0.0
        assert got == (pytest.approx(want, rel=1e-9) if variance else 0.0)


@pytest.mark.parametrize("scorer", ["path", "box"])
def test_points_with_one_id_stay_apart(spark, scorer):
    rows = [(1, 0, 0, i * 7 % 80, i * 11 % 150) for i in range(20)]
    params = Params(trees=2, seed=1, neighborhood_size=3, max_depth=8, scorer=scorer)
    found = detect(points(spark, rows), params).points.collect()
    assert len({(r.x, r.y) for r in found}) == len(found) == 20


def test_windows_with_null_times_keep_and_expire_all(spark):
    rows = [(i, 0, i % 3, 0, 0) for i in range(12)]
    df = points(spark, rows).withColumn("ts", F.when(F.col("point_id") % 4 != 0, F.col("ts")))
    for size in (1, 4, 9, 10, 11, 12, 50):
        kept = {r.point_id for r in window.window_count(df, size).collect()}
        gone = {r.point_id for r in window.expired_count(df, size).collect()}
        order = sorted(rows, key=lambda r: (r[0] % 4 != 0, r[2] if r[0] % 4 else 0, r[0]), reverse=True)
        assert kept == {r[0] for r in order[:size]} and gone == {r[0] for r in order[size:]}
    now = F.lit(START + timedelta(seconds=2)).cast("timestamp")
    kept = {r.point_id for r in window.window_time(df, now, 2).collect()}
    gone = {r.point_id for r in window.expired_time(df, now, 2).collect()}
    assert kept == {r[0] for r in rows if r[0] % 4 and r[2] > 0} and kept | gone == set(range(12)) and not kept & gone
