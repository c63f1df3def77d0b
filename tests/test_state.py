"""Segments, histograms, the end of a count window, updates of trees, and batches from folders."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridscan.config import Params
from gridscan.operators import cells, codes, grids
from gridscan.operators.batch import dedup_batch
from gridscan.operators.window import newest_cut
from gridscan.plans.detect import detect
from gridscan.plans.tables import shared_dir
from gridscan.sources.points import batch_folders
from gridscan.sources.sinks import read_metrics, read_scores
from gridscan.streaming import run, state as S
from gridscan.streaming.histogram import BUCKETS, TimeHistogram, histogram_of, merged, shift_for, window_edge
from gridscan.streaming.run import StreamOptions, advance_window, count_cut, edge_points, next_manifest, run_folders
from gridscan.streaming.state import Manifest, WindowState
from test_golden import points
from test_properties import UNIT, skewed

PARAMS = Params(max_depth=8, neighborhood_size=5, domain=UNIT, window_size=60)
EVENT = StreamOptions(clock="event")


def histogram(times, nulls=0):
    shift = shift_for(min(times), max(times)) if times else 0
    buckets = {}
    for t in times:
        buckets[t >> shift] = buckets.get(t >> shift, 0) + 1
    return TimeHistogram(shift, tuple(sorted(buckets.items())), nulls)


def test_histograms_merge_exactly():
    rng = random.Random(1)
    sets = [[rng.randrange(-(10**e), 10**e) for _ in range(50)] for e in (1, 4, 7, 15)]
    whole = merged([histogram(s) for s in sets])
    assert whole == histogram([t for s in sets for t in s]) and len(whole.counts) <= BUCKETS
    assert merged([]) == TimeHistogram() and merged([histogram([], 3), histogram([5], 1)]).total == 5


@pytest.mark.parametrize("nulls", [0, 7])
def test_the_edge_holds_the_last_point_of_the_window(nulls):
    rng = random.Random(2)
    sets = [sorted(rng.randrange(10**e) for _ in range(40)) for e in (2, 5, 8)]
    order = sorted((t for s in sets for t in s), reverse=True)
    parts = [histogram(s, nulls) for s in sets]
    total = len(order) + 3 * nulls
    for size in range(1, total):
        edge = window_edge(parts, size)
        if edge.low_us is None:
            assert size > len(order) and edge.rank == size - len(order) and edge.n == 3 * nulls
        else:
            newer = sum(t >= edge.high_us for t in order)
            assert edge.low_us <= order[size - 1] < edge.high_us and edge.rank == size - newer
    assert window_edge(parts, total) is None


def day(spark, rows):
    """Points from (id, second or None)."""
    schema = "point_id long, batch_id long, ts timestamp, x double, y double"
    rows = [(i, 0, None, i / 1000, 0.5) if t is None else (i, 0, t, i / 1000, 0.5) for i, t in rows]
    df = spark.createDataFrame(rows, "point_id long, batch_id long, s double, x double, y double")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).select(*[c.split()[0] for c in schema.split(", ")])


def ids(df):
    return sorted(r.point_id for r in df.collect())


@pytest.mark.parametrize("sizes", [1, 37, 90, 101, 119])
def test_count_cut_equals_the_cut_over_all_points(spark, sizes):
    rng = random.Random(3)
    state, segments, rows = WindowState(spark, shared_dir(spark)), (), []
    for b in range(4):
        own = [(30 * b + i, None if rng.random() < 0.1 else float(rng.randrange(100 * b, 100 * b + 150))) for i in range(30)]
        rows += own
        segments += (state.write_points(day(spark, own), f"b={b}"),)
    assert count_cut(state, segments, sizes) == newest_cut(day(spark, rows), sizes)
    assert count_cut(state, segments, 120) is None


def files_read(df):
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def test_only_segments_at_the_edge_are_read(spark):
    state, segments = WindowState(spark, shared_dir(spark)), ()
    for b in range(6):
        segments += (state.write_points(day(spark, [(20 * b + i, 1000.0 * b + i) for i in range(20)]), f"b={b}"),)
    edge = window_edge([s.times for s in segments], 50)
    rows = edge_points(state, segments, edge.low_us, edge.high_us)
    assert files_read(rows) == {"b=3"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
    assert count_cut(state, segments, 50).point_id == 70


def test_many_small_batches_leave_few_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN", 3)
    rng = random.Random(4)
    state, manifest, rows = WindowState(spark, shared_dir(spark)), Manifest(), []
    params = replace(PARAMS, window_size=100)
    for b in range(60):
        own = [(5 * b + i, rng.choice((float(10 * b + i), float(10 * b - 15 + i)))) for i in range(5)]
        rows += own
        new = state.write_points(day(spark, own), f"b={b}")
        manifest = next_manifest(state, manifest, new, params, EVENT)
        manifest = replace(manifest, points=state.compact_points(manifest.points, manifest.cut, b, params.window_size))
        assert len(manifest.points) <= 24
        # Expired points take at most a share of the window per segment.
        assert sum(s.n for s in manifest.points) <= 250
    newest = sorted(rows, key=lambda r: (r[1], r[0]))[-100:]
    assert ids(state.window(manifest)) == sorted(i for i, _ in newest)
    assert manifest.n == 100
    assert state.window(manifest).select("point_id").distinct().count() == 100


def test_codes_cancel_out(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN", 4)
    state, segments, live = WindowState(spark, shared_dir(spark)), (), {}
    for b in range(14):
        changes = {(0, 7 * b % 40): 1, (0, 7 * (b - 3) % 40): -1 if b >= 3 else 0}
        for key, n in changes.items():
            live[key] = live.get(key, 0) + n
        df = spark.createDataFrame([(t, c, n) for (t, c), n in changes.items()], "tree int, code long, n long")
        made = state.write_codes(df, 3, f"b={b}")
        segments = state.compact_codes(segments + (made,), 3, b)
        assert len(segments) <= 8
    got = {(r.tree, r.code): r.n for r in state.window_codes(segments).collect()}
    assert got == {k: n for k, n in live.items() if n}
    only = state.window_codes(segments, [0])
    assert "part" in only._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_codes_inside_cells(spark):
    df = points(spark, skewed(400, 5))
    coded = codes.code_counts(grids.code_points(df, PARAMS))
    tree = cells.build_cells(codes.code_leaves(coded, PARAMS), PARAMS)
    some = tree.where("is_leaf and n > 2")
    got = cells.codes_inside(coded, some, PARAMS)
    located = codes.locate(coded, cells.leaf_cells(tree), PARAMS).join(
        some.select("tree", F.col("level").alias("leaf_level"), F.col("cell").alias("leaf_cell")), ["tree", "leaf_level", "leaf_cell"]
    )
    expected = sorted((r.tree, r.code, r.n, r.leaf_level) for r in located.collect())
    assert sorted((r.tree, r.code, r.n, r.old_level) for r in got.collect()) == expected != []


def test_coarse_parts(spark):
    rows = [(0, 0, 0, 0, True)], [(0, 2, 5, 0, True), (0, 8, 4**5 * 7 + 3, 0, True)], [(0, 3, 9, 0, True)], []
    found = [run.coarse_parts(spark.createDataFrame(r, S.CELL_SCHEMA), PARAMS) for r in rows]
    assert found == [list(range(64)), [7, 20, 21, 22, 23], [9], []]


def test_an_update_reads_no_old_points_and_few_codes(spark, monkeypatch):
    path = shared_dir(spark)
    state = WindowState(spark, path)
    params = replace(PARAMS, window_size=10_000)
    options = StreamOptions(clock="event", mode="incremental", scope="batch")
    rows = [(i, i // 200, i, x, y) for i, _, _, x, y in skewed(600, 6)]
    rows += [(1000 + i, 3, 1000 + i, 0.9 + i / 10_000, 0.95) for i in range(40)]
    df = points(spark, rows)
    for b in range(3):
        advance_window(df.where(F.col("batch_id") == b), b, state, params, options)
    seen = []
    plain_points, plain_codes = WindowState.points, WindowState.window_codes

    def read_points(self, segments):
        seen.append(("points", tuple(s.name for s in segments)))
        return plain_points(self, segments)

    def read_codes(self, segments, parts=None):
        seen.append(("codes", parts))
        return plain_codes(self, segments, parts)

    monkeypatch.setattr(S, "FAN", 20)  # merging now and then reads all codes, but not in this batch
    monkeypatch.setattr(WindowState, "points", read_points)
    monkeypatch.setattr(WindowState, "window_codes", read_codes)
    advance_window(df.where("batch_id = 3"), 3, state, params, options)
    assert {names for kind, names in seen if kind == "points"} <= {("b=3",), ()}
    read = [parts for kind, parts in seen if kind == "codes"]
    assert read and all(parts is not None and len(parts) <= 4 for parts in read)
    monkeypatch.undo()
    whole = detect(dedup_batch(df), params)
    assert sorted(map(tuple, state.cells(3).collect())) == sorted(map(tuple, whole.cells.collect()))
    scores = {(r.point_id, r.node_id, round(r.score, 9)) for r in read_scores(spark, path, 3).collect()}
    assert scores == {(r.point_id, r.node_id, round(r.score, 9)) for r in whole.points.where("batch_id = 3").collect()}


@pytest.mark.parametrize("mode", ["recompute", "incremental"])
def test_empty_late_and_timeless_batches(spark, mode):
    path = shared_dir(spark)
    state = WindowState(spark, path)
    options = StreamOptions(clock="event", mode=mode)
    batches = [
        [],
        [(i, float(100 + i)) for i in range(40)],
        [],
        [(100 + i, float(i)) for i in range(40)],  # half of them are too old
        [(200 + i, None) for i in range(10)],  # older than all others
        [(300 + i, float(500 + i)) for i in range(55)],
    ]
    rows = []
    for b, own in enumerate(batches):
        rows += own
        advance_window(day(spark, own), b, state, PARAMS, options)
        newest = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))[-60:]
        manifest = state.read_manifest(b)
        assert ids(state.window(manifest)) == sorted(i for i, _ in newest) and manifest.n == len(newest)
        assert {r.point_id for r in read_scores(spark, path, b).collect()} == {i for i, _ in newest}
        window = state.window(manifest)
        expected = detect(spark.createDataFrame(window.collect(), window.schema), PARAMS).cells
        assert sorted(map(tuple, state.cells(b).collect())) == sorted(map(tuple, expected.collect()))
    assert [r.window_count for r in read_metrics(spark, path).orderBy("batch_id").collect()] == [0, 40, 40, 60, 60, 60]


def test_a_point_from_the_future_does_not_empty_the_window_by_processing_time(spark, monkeypatch):
    monkeypatch.setattr(run, "_micros_now", lambda: 200_000_000)
    params = replace(PARAMS, window_type="time", window_size=100)
    rows = [(1, 50.0), (2, 101.0), (3, 150.0), (4, 9_000.0), (5, None)]
    kept = {}
    for now in ("newest", "processing"):
        state = WindowState(spark, shared_dir(spark))
        options = StreamOptions(clock="event", now=now)
        new = state.write_points(day(spark, rows), "b=0")
        manifest = next_manifest(state, Manifest(), new, params, options)
        kept[now] = ids(state.window(manifest))
        assert manifest.n == len(kept[now])
    assert kept == {"newest": [4], "processing": [2, 3, 4]}


def test_segments_of_finished_batches_are_removed(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN", 2)
    path = shared_dir(spark)
    state = WindowState(spark, path)
    options = StreamOptions(clock="event", mode="incremental", scope="batch")
    for b in range(5):
        own = [(20 * b + i, float(20 * b + i)) for i in range(20)]
        advance_window(day(spark, own), b, state, PARAMS, options)
        before = state.read_manifest(b - 1) if b else Manifest()
        after = state.read_manifest(b)
        needed = {s.name for m in (before, after) for s in m.points}
        assert set(run_names(spark, f"{path}/points")) == needed
        assert set(run_names(spark, f"{path}/codes")) == {s.name for m in (before, after) for s in m.codes}


def run_names(spark, path):
    from gridscan.plans import files

    return files.names(spark, path)


def write_folder(folder, rows, parts, complete=True):
    folder.mkdir()
    for k in range(parts):
        (folder / f"part-{k}.txt").write_text("".join(f"{x!r},{y!r}\n" for *_, x, y in rows[k::parts]))
    if complete:
        (folder / "_SUCCESS").write_text("")


def test_a_folder_is_one_batch_and_keeps_its_number(spark, tmp_path):
    rows = skewed(180, 8)
    params = replace(PARAMS, window_size=10_000)
    options = StreamOptions(mode="incremental")
    path = shared_dir(spark)
    write_folder(tmp_path / "batch_10", rows[120:], 3)
    write_folder(tmp_path / "batch_2", rows[:60], 4)
    write_folder(tmp_path / "batch_5", rows[60:120], 2, complete=False)
    write_folder(tmp_path / "other_1", rows[:5], 1)
    assert batch_folders(spark, str(tmp_path)) == [(2, "batch_2"), (10, "batch_10")]
    state = run_folders(spark, str(tmp_path), path, params, options, batches=1)
    assert state.latest() == 2
    (tmp_path / "batch_5" / "_SUCCESS").write_text("")
    (tmp_path / "batch_12.txt").write_text("0.25,0.75\n")
    run_folders(spark, str(tmp_path), path, params, options)
    run_folders(spark, str(tmp_path), path, params, options)
    assert [r.batch_id for r in read_metrics(spark, path).orderBy("batch_id").collect()] == [2, 5, 10, 12]
    unique = {({0: 2, 1: 5, 2: 10}[i // 60], x, y) for i, (*_, x, y) in enumerate(rows)} | {(12, 0.25, 0.75)}
    whole = detect(points(spark, [(i, b, 0, x, y) for i, (b, x, y) in enumerate(sorted(unique))]), params)
    expected = sorted((r.batch_id, r.x, r.y, r.node_id, round(r.score, 9)) for r in whole.points.collect())
    got = sorted((r.batch_id, r.x, r.y, r.node_id, round(r.score, 9)) for r in read_scores(spark, path, 12).collect())
    assert got == expected


def test_two_batches_with_one_number_are_an_error(spark, tmp_path):
    write_folder(tmp_path / "batch_1", skewed(5, 1), 1)
    (tmp_path / "batch_1.txt").write_text("1,2\n")
    with pytest.raises(ValueError, match="same number"):
        batch_folders(spark, str(tmp_path))


def test_histogram_of_points(spark):
    df = day(spark, [(1, 5.0), (2, 5.0), (3, 900.0), (4, None)])
    assert histogram_of(df, 5_000_000, 900_000_000, 4, 1).total == 4
    assert histogram_of(df.where("point_id < 3"), 5_000_000, 5_000_000, 2, 0) == TimeHistogram(0, ((5_000_000, 2),))
    assert histogram_of(df, None, None, 2, 2) == TimeHistogram(nulls=2)
