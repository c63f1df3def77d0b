"""Streaming state: both modes, restarts, repeated batches, and equality with batch jobs."""

import os
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridscan.config import Params
from gridscan.plans.detect import detect
from gridscan.plans.tables import shared_dir
from gridscan.sources.points import stream_points
from gridscan.sources.sinks import read_metrics, read_scores
from gridscan.streaming.run import StreamOptions, advance_window, replay, run_stream
from gridscan.streaming.state import WindowState
from test_golden import points
from test_properties import UNIT, skewed

PARAMS = Params(max_depth=10, neighborhood_size=5, domain=UNIT, window_size=250)


def batches(spark, n=500, size=100):
    rows = [(i, i // size, i, x, y) for i, _, _, x, y in skewed(n, 11)]
    return points(spark, rows)


def state_of(state, batch_id):
    return sorted(map(tuple, state.cells(batch_id).collect()))


def scores_of(spark, path, batch_id):
    return sorted(
        (r.point_id, r.node_id, round(r.score, 9)) for r in read_scores(spark, path, batch_id).collect()
    )


@pytest.mark.parametrize(
    "change", [{}, {"window_type": "time", "window_size": 150, "max_depth": 7}, {"trees": 2, "seed": 3, "max_depth": 7}]
)
def test_incremental_equals_recomputed_after_every_batch(spark, change):
    params = replace(PARAMS, **change)
    df = batches(spark)
    runs = {}
    for mode in ("recompute", "incremental"):
        path = shared_dir(spark)
        state = WindowState(spark, path)
        runs[mode] = []
        for b in range(4):
            advance_window(df.where(F.col("batch_id") == b), b, state, params, StreamOptions(clock="event", mode=mode))
            window = state.window(state.read_manifest(b))
            ids = sorted(r.point_id for r in window.collect())
            runs[mode].append((ids, state_of(state, b), scores_of(spark, path, b)))
    assert runs["recompute"] == runs["incremental"]
    final = detect(spark.createDataFrame(window.collect(), window.schema), params)
    assert sorted(map(tuple, final.cells.collect())) == runs["recompute"][-1][1]


def test_repeating_a_batch_changes_nothing(spark):
    df, path = batches(spark, 200), shared_dir(spark)
    options, params = StreamOptions(clock="event", mode="incremental"), replace(PARAMS, max_depth=7, window_size=150)
    state = replay(df, [0, 1], path, params, options)
    before = (state.read_manifest(1), state_of(state, 1), scores_of(spark, path, 1))
    advance_window(df.where("batch_id = 1"), 1, state, params, options)
    assert (state.read_manifest(1), state_of(state, 1), scores_of(spark, path, 1)) == before
    assert read_metrics(spark, path).count() == 2


def test_missing_state_is_an_error(spark):
    state = WindowState(spark, shared_dir(spark))
    with pytest.raises(ValueError, match="no complete state"):
        advance_window(batches(spark, 100), 3, state, PARAMS, StreamOptions())


def test_old_versions_are_removed(spark):
    path = shared_dir(spark)
    replay(batches(spark), [0, 1, 2, 3, 4], path, replace(PARAMS, window_size=120, max_depth=7))
    assert sorted(d for d in os.listdir(path) if d.startswith("v=")) == ["v=3", "v=4"]
    # Batch 2 is needed by version 3 only.
    assert sorted(os.listdir(f"{path}/points")) == ["b=2", "b=3", "b=4"]


def write_file(folder, number, rows):
    target = folder / f"batch_{number}.txt"
    target.write_text("".join(f"{x!r},{y!r}\n" for *_, x, y in rows))
    stamp = time.time() - 1000 + number
    os.utime(target, (stamp, stamp))


def run_all(spark, folder, path, params, options):
    query = run_stream(stream_points(spark, str(folder)), path, params, options, available_now=True)
    query.awaitTermination()


@pytest.mark.parametrize("mode", ["recompute", "incremental"])
def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path, mode):
    rows = skewed(240, 21)
    options = StreamOptions(mode=mode)
    params = replace(PARAMS, window_size=10_000, max_depth=8)
    path = shared_dir(spark)
    for number in range(2):
        write_file(tmp_path, number, rows[80 * number : 80 * (number + 1)])
    run_all(spark, tmp_path, path, params, options)
    write_file(tmp_path, 2, rows[160:])
    run_all(spark, tmp_path, path, params, options)
    run_all(spark, tmp_path, path, params, options)
    unique = {(i // 80, x, y) for i, (*_, x, y) in enumerate(rows)}
    whole = detect(points(spark, [(i, b, 0, x, y) for i, (b, x, y) in enumerate(sorted(unique))]), params)
    expected = sorted((r.batch_id, r.x, r.y, r.node_id, round(r.score, 9)) for r in whole.points.collect())
    got = sorted((r.batch_id, r.x, r.y, r.node_id, round(r.score, 9)) for r in read_scores(spark, path, 2).collect())
    assert got == expected
    metrics = read_metrics(spark, path).orderBy("batch_id").collect()
    assert [r.batch_id for r in metrics] == [0, 1, 2] and metrics[-1].window_count == len(unique)


def test_arrival_clock_cuts_the_oldest_batch(spark, tmp_path):
    rows = [(i, 0, 0, i / 300, 0.5) for i in range(300)]
    path = shared_dir(spark)
    for number in range(3):
        write_file(tmp_path, number, rows[100 * number : 100 * (number + 1)])
    run_all(spark, tmp_path, path, replace(PARAMS, window_size=130, max_depth=7), StreamOptions(mode="incremental", scope="batch"))
    counts = {r.batch_id: r.window_count for r in read_metrics(spark, path).collect()}
    assert counts == {0: 100, 1: 130, 2: 130}
    state = WindowState(spark, path)
    window = state.window(state.read_manifest(2)).groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in window} == {1: 30, 2: 100}
    assert {r.batch_id for r in read_scores(spark, path, 2).collect()} == {2}
    assert read_scores(spark, path, 2).count() == 100
