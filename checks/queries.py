"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import datasets as D
from gridscan.config import Params
from gridscan.functions import geometry as G
from gridscan.operators import assign, batch, cells, codes, grids, score, window
from gridscan.operators.paths import path_counts
from gridscan.plans import report
from gridscan.plans.detect import detect
from gridscan.plans.tables import write_table
from gridscan.sources.points import parse_points, read_points_text, stream_points
from gridscan.sources.sinks import read_metrics, read_scores
from gridscan.streaming.run import StreamOptions, next_manifest, replay, run_folders, run_stream
from gridscan.streaming.state import Manifest, WindowState

Query = Callable[[SparkSession, str], DataFrame]

WINDOW_SHARE = 4  # the count window of the checks: number of events divided by this
REPLAY_DAYS = 6  # days per batch in replays, five batches in all
HALF_DAYS = 15  # the two halves of the month, for updates


def _six(value: Column, name: str) -> Column:
    """Round to 6 places; adding zero turns a negative zero into zero."""
    return (F.round(value, 6) + F.lit(0.0)).alias(name)


def _text(counts: Column) -> Column:
    return F.array_join(counts.cast("array<string>"), ",")


def _lines(points: DataFrame) -> DataFrame:
    """Points written as text lines with a third field that parsing ignores."""
    value = F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"), F.lit("rest"))
    return points.withColumn("value", value)


def _trees(spark: SparkSession, sf_dir: str, params: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coded events, codes with their leaf, and cells."""
    coded = grids.code_points(D.events(spark, sf_dir), params)
    by_code = codes.code_leaves(codes.code_counts(coded), params)
    return coded, by_code, cells.build_cells(by_code, params)


def _located(spark: SparkSession, sf_dir: str, params: Params) -> DataFrame:
    coded, by_code, _ = _trees(spark, sf_dir, params)
    return assign.assign_leaf(coded, by_code, assign.hot_codes(codes.code_counts(coded), params.trees), params)


# Sources and single-batch steps


def q_parse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(D.raw_events(spark, sf_dir)).select("point_id", "value")
    return parse_points(lines).select("point_id", "x", "y")


def q_read_points_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = D.work_folder(spark)
    lines = _lines(D.raw_events(spark, sf_dir, REPLAY_DAYS)).select("batch_id", "value")
    lines.write.partitionBy("batch_id").text(path)
    return read_points_text(spark, path).select("batch_id", "x", "y")


def q_points_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.raw_events(spark, sf_dir, 1)
    return points.withColumn("ts", F.unix_micros("ts"))


def q_stamp_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.raw_events(spark, sf_dir, 1)
    arrival = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("batch_id") * 30)
    stamped = batch.stamp_batch(points, arrival)
    return stamped.select("point_id", "batch_id", F.unix_micros("ts").alias("ts_us"))


def q_dedup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.events(spark, sf_dir, 1).select("point_id", "batch_id", F.unix_micros("ts").alias("ts_us"), "x", "y")


def q_duplicate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.duplicate_points(D.raw_events(spark, sf_dir))


# Grid expressions


def q_shift_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.shift_points(D.events(spark, sf_dir), D.FOUR).select(
        "point_id", "tree", _six(F.col("u"), "u"), _six(F.col("v"), "v")
    )


def q_shift_points_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.shift_points(D.events(spark, sf_dir), D.DRAWN).select(
        "point_id", "tree", _six(F.col("u"), "u"), _six(F.col("v"), "v")
    )


def q_in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.events(spark, sf_dir).select(
        "point_id", G.in_domain(F.col("x"), F.col("y"), D.NARROW_DOMAIN).alias("in_domain")
    )


def q_cell_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.code_points(D.events(spark, sf_dir), D.FOUR).select("point_id", "tree", "code")


def q_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = (F.lit(1024.0), F.lit(512.0))
    return D.events(spark, sf_dir).select(
        "point_id", _six(G.distance(F.col("x"), F.col("y"), *middle), "distance")
    )


# Counts and cells


def q_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = grids.code_points(D.events(spark, sf_dir), D.FOUR)
    return codes.cell_counts(codes.code_counts(coded), D.FOUR)


def q_code_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, D.FOUR)[1]


def q_build_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, D.FOUR)[2]


def q_build_cells_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir, D.NARROW)[2]


def q_leaf_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.leaf_cells(_trees(spark, sf_dir, D.ONE)[2]).drop("is_leaf")


def q_describe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = report.describe_cells(_trees(spark, sf_dir, D.ONE)[2], D.ONE)
    return listing.withColumn("path_counts", _text(F.col("path_counts")))


def q_avg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.avg_nodes(_trees(spark, sf_dir, D.FOUR)[2], D.FOUR)


def q_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = cells.leaf_cells(path_counts(_trees(spark, sf_dir, D.ONE)[2], D.ONE))
    return leaves.select("tree", "level", "cell", _text(F.col("path_counts")).alias("path_counts"))


# Retention


def _window_size(points: DataFrame) -> int:
    return points.count() // WINDOW_SHARE


def _times(points: DataFrame) -> DataFrame:
    return points.select("point_id", "batch_id", F.unix_micros("ts").alias("ts_us"))


def q_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.events(spark, sf_dir, 1)
    return _times(window.window_count(points, _window_size(points)))


def q_window_count_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.events(spark, sf_dir, 1)
    points = points.withColumn("ts", F.when(F.col("point_id") % 7 != 0, F.col("ts")))
    # The window ends among the points without a time.
    return _times(window.window_count(points, points.count() * 9 // 10))


def q_window_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.events(spark, sf_dir, 1)
    params = replace(D.ONE, window_size=_window_size(points))
    state, manifest = WindowState(spark, D.work_folder(spark)), Manifest()
    days = [r["batch_id"] for r in points.select("batch_id").distinct().orderBy("batch_id").collect()]
    for day in days:
        came = state.write_points(points.where(F.col("batch_id") == day), f"b={day}")
        manifest = next_manifest(state, manifest, came, params, StreamOptions(clock="event"))
        merged = state.compact_points(manifest.points, manifest.cut, day, params.window_size)
        manifest = replace(manifest, points=merged)
    return _times(state.window(manifest))


def q_expired_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = D.events(spark, sf_dir, 1)
    return _times(window.expired_count(points, _window_size(points)))


TEN_DAYS = 864_000


def _now() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def q_window_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(window.window_time(D.events(spark, sf_dir, 1), _now(), TEN_DAYS))


def q_expired_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(window.expired_time(D.events(spark, sf_dir, 1), _now(), TEN_DAYS))


# Updates: the first half of the month is in the trees, the second half arrives


def _halves(spark: SparkSession, sf_dir: str, params: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes of either half and the cells of the first."""
    coded = grids.code_points(D.events(spark, sf_dir, HALF_DAYS), params)
    first = codes.code_counts(coded.where(F.col("batch_id") == 0))
    second = codes.code_counts(coded.where(F.col("batch_id") == 1))
    old = cells.build_cells(codes.code_leaves(first, params), params)
    # As in the stream, the trees so far are a written table.
    return first, second, write_table(old, D.work_folder(spark))


def _grown(spark: SparkSession, sf_dir: str, params: Params) -> tuple[DataFrame, DataFrame]:
    """Codes of the month, and the first half's cells with the counts of the month."""
    first, second, old = _halves(spark, sf_dir, params)
    located = codes.locate(second, cells.leaf_cells(old), params)
    both = first.unionByName(second).groupBy("tree", "code").agg(F.sum("n").alias("n"))
    return both, cells.apply_deltas(old, cells.path_deltas(located))


def q_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, second, old = _halves(spark, sf_dir, D.FOUR)
    return codes.locate(second, cells.leaf_cells(old), D.FOUR)


def q_path_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, second, old = _halves(spark, sf_dir, D.ONE)
    return cells.path_deltas(codes.locate(second, cells.leaf_cells(old), D.ONE))


def q_apply_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(spark, sf_dir, D.ONE)[1]


def q_cells_to_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.cells_to_split(_grown(spark, sf_dir, D.ONE)[1], D.ONE).drop("is_leaf")


def q_split_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, grown = _grown(spark, sf_dir, D.ONE)
    return cells.split_cells(write_table(grown, D.work_folder(spark)), both, D.ONE)


def q_trim_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = grids.code_points(D.events(spark, sf_dir, HALF_DAYS), D.ONE)
    old = cells.build_cells(codes.code_leaves(codes.code_counts(coded), D.ONE), D.ONE)
    old = write_table(old, D.work_folder(spark))
    leaving = codes.code_counts(coded.where(F.col("batch_id") == 0)).withColumn("n", -F.col("n"))
    located = codes.locate(leaving, cells.leaf_cells(old), D.ONE)
    return cells.trim_cells(cells.apply_deltas(old, cells.path_deltas(located)), D.ONE)


# Points in cells


def q_assign_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, D.FOUR).select(
        "point_id", "tree", G.node_id(F.col("leaf_level"), F.col("leaf_cell")).alias("node_id")
    )


def q_center_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, D.FOUR).select("point_id", "tree", _six(F.col("distance"), "distance"))


def q_node_at_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.node_at_level(_located(spark, sf_dir, D.FOUR), 4).select(
        "point_id", "tree", "node_level", "node_cell"
    )


def q_nearest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    nearest = score.nearest_grid(_located(spark, sf_dir, D.FOUR), 4, D.FOUR)
    return nearest.select(
        "point_id", "tree", "node_level", "node_cell", _six(F.col("distance"), "distance")
    )


# Scores


def q_score_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = score.score_path(_trees(spark, sf_dir, D.FOUR)[2], D.FOUR)
    return leaves.select("tree", "level", "cell", _six(F.col("score"), "score"))


def q_score_path_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = replace(D.ONE, exact=True)
    leaves = score.score_path(_trees(spark, sf_dir, params)[2], params)
    return leaves.select("tree", "level", "cell", _six(F.col("score"), "score"))


def _box(params: Params, alpha: int) -> Params:
    return replace(params, scorer="box", alpha=alpha)


def q_frontier_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = _box(D.ONE, 2)
    moments = score.frontier_moments(_trees(spark, sf_dir, params)[2], params)
    moments = moments.drop("s3_high", "s3_low")
    return moments.withColumns({c: F.col(c).cast("long") for c in ("s2", "s3")})


def q_mdef_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = _box(D.ONE, 2)
    tree = _trees(spark, sf_dir, params)[2]
    pairs = score.pair_scores(tree, score.frontier_moments(tree, params), params)
    return pairs.select("level", "cell", "sampling_level", _six(F.col("score"), "score"))


def q_score_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = _box(D.FOUR, 4)
    leaves = score.score_box(_trees(spark, sf_dir, params)[2], params)
    return leaves.select("tree", "level", "cell", _six(F.col("score"), "score"))


def _scored(points: DataFrame, params: Params) -> DataFrame:
    scored = detect(points, params, D.work_folder(points.sparkSession)).points
    return scored.select(
        "point_id", "tree", "node_id", _six(F.col("distance"), "distance"), _six(F.col("score"), "score")
    )


def q_score_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(D.events(spark, sf_dir), D.FOUR)


def q_score_points_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(D.events(spark, sf_dir), D.ONE)


def q_score_points_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(D.events(spark, sf_dir), D.NARROW)


def q_score_points_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(D.lineitem(spark, sf_dir), D.LINEITEM)


def q_score_points_lineitem_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(D.lineitem(spark, sf_dir), D.LINEITEM_FOUR)


def q_score_points_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(D.embeddings(spark, sf_dir), D.EMBEDDING)


def q_score_points_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(D.events(spark, sf_dir), _box(D.ONE, 4))


def q_score_points_box_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(D.events(spark, sf_dir), _box(D.ONE, 2))


def q_score_points_box_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(D.events(spark, sf_dir), _box(D.FOUR, 4))


# Reports and the whole pipeline


def q_batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _trees(spark, sf_dir, D.FOUR)[2]
    row = report.batch_metrics(D.events(spark, sf_dir), tree, D.FOUR, 0, 0)
    return row.drop("seconds")


def _replayed(spark: SparkSession, sf_dir: str, mode: str, **changes) -> str:
    raw = D.raw_events(spark, sf_dir, REPLAY_DAYS)
    params = replace(D.ONE, **{"window_size": raw.count() // WINDOW_SHARE} | changes)
    path = D.work_folder(spark)
    replay(raw, [0, 1, 2, 3, 4], path, params, StreamOptions(clock="event", mode=mode))
    return path


def _final_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_scores(spark, path, 4).select(
        "point_id", "batch_id", "node_id", _six(F.col("score"), "score")
    )


def q_advance_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final_scores(spark, _replayed(spark, sf_dir, "recompute"))


def q_advance_window_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final_scores(spark, _replayed(spark, sf_dir, "incremental"))


def q_advance_window_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _replayed(spark, sf_dir, "incremental", window_type="time", window_size=TEN_DAYS)
    return _final_scores(spark, path)


def q_replay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_metrics(spark, _replayed(spark, sf_dir, "incremental")).drop("seconds")


def q_stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = D.work_folder(spark)
    lines = _lines(D.raw_events(spark, sf_dir, REPLAY_DAYS))
    for number in range(5):
        part = lines.where(F.col("batch_id") == number).select("value")
        # One file is one micro-batch of the stream.
        part.coalesce(1).write.mode("append").text(source)
    path = D.work_folder(spark)
    stream = run_stream(stream_points(spark, source), path, D.ONE, available_now=True)
    stream.awaitTermination()
    return read_scores(spark, path, 4).select("batch_id", "x", "y", "node_id", _six(F.col("score"), "score"))


def q_stream_scores_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, path = D.work_folder(spark), D.work_folder(spark)
    lines = _lines(D.raw_events(spark, sf_dir, REPLAY_DAYS))
    for number in range(5):
        # A folder of several files is one batch.
        part = lines.where(F.col("batch_id") == number).select("value")
        part.repartition(3).write.text(f"{source}/batch_{number}")
    run_folders(spark, source, path, D.ONE, StreamOptions(mode="incremental"))
    return read_scores(spark, path, 4).select("batch_id", "x", "y", "node_id", _six(F.col("score"), "score"))


def all_queries() -> dict[str, Query]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}
