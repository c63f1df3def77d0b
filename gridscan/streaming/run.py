"""The streaming pipeline: one window advance per micro-batch."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridscan.config import DEFAULT_TRIGGER_SECONDS, Params
from gridscan.operators.assign import hot_codes
from gridscan.operators.batch import dedup_batch, stamp_batch
from gridscan.operators.cells import (
    apply_deltas,
    build_cells,
    cells_on_paths,
    cells_to_split,
    leaf_cells,
    path_deltas,
    split_cells,
    trim_cells,
)
from gridscan.operators.codes import code_counts, code_leaves, locate
from gridscan.operators.grids import code_points
from gridscan.operators.score import score_codes, score_coded, score_leaves
from gridscan.operators.window import FIRST, Cut, cut_at_rank, key_rows
from gridscan.plans.report import batch_metrics
from gridscan.plans.tables import write_table
from gridscan.sources.points import batch_folders, read_batch_folder, with_ids
from gridscan.sources.sinks import write_metrics, write_scores
from gridscan.streaming.histogram import window_edge
from gridscan.streaming.state import COARSE, Manifest, Segment, WindowState

CLOCKS = ("arrival", "event")
MODES = ("recompute", "incremental")
SCOPES = ("window", "batch")
NOWS = ("newest", "processing")


@dataclass(frozen=True)
class StreamOptions:
    """How a stream is processed.

    ``clock``: 'arrival' stamps each batch once; 'event' keeps the column ``ts`` and needs a
    unique ``point_id``. ``mode``: 'recompute' builds the trees from the window, 'incremental'
    updates the cells of the batch before. ``scope``: score the whole window after each
    batch, or only the batch's own points. ``trigger_seconds``: how often a stream looks for files.
    ``now``: a time window ends at the newest time seen, or at the time of processing, which a
    point from the future cannot move.
    """

    clock: str = "arrival"
    mode: str = "recompute"
    scope: str = "window"
    trigger_seconds: float = DEFAULT_TRIGGER_SECONDS
    now: str = "newest"

    def __post_init__(self) -> None:
        if self.clock not in CLOCKS or self.mode not in MODES or self.scope not in SCOPES or self.now not in NOWS:
            raise ValueError(f"clock, mode, scope, now must be of {CLOCKS}, {MODES}, {SCOPES}, {NOWS}")


def _micros_now() -> int:
    return time.time_ns() // 1000


def next_manifest(
    state: WindowState, before: Manifest, new: Segment | None, params: Params, options: StreamOptions
) -> Manifest:
    """Which points the window holds once the new segment is in."""
    segments = before.points + ((new,) if new else ())
    newest = max((us for us in (before.newest_us, new and new.last_us) if us is not None), default=None)
    if params.window_type == "time":
        now = _micros_now() if options.now == "processing" else newest or 0
        cut = Cut(now - params.window_size * 1_000_000 + 1, -(1 << 63))
        kept = tuple(s for s in segments if s.last_us is not None and s.last_us >= cut.ts_us)
        if all(s.times.nulls == 0 and s.first_us >= cut.ts_us for s in kept):
            cut = None
    else:
        cut = count_cut(state, segments, params.window_size) or before.cut
        kept = tuple(s for s in segments if cut is None or _reaches(s, cut))
    n = before.n + (new.n if new else 0)
    after = Manifest(kept, cut, n, newest_us=newest)
    if params.window_type == "count":
        return replace(after, n=min(n, params.window_size))
    gone = _gone_points(state, before, after, new)
    return replace(after, n=n - (gone.count() if gone is not None else 0))


def _reaches(segment: Segment, cut: Cut) -> bool:
    """Whether a segment may hold points of the window."""
    if cut.ts_us == FIRST:
        return True
    return segment.last_us is not None and segment.last_us >= cut.ts_us


def count_cut(state: WindowState, segments: tuple[Segment, ...], size: int) -> Cut | None:
    """Key of the ``size``-th newest stored point; None if there are no more points.

    The segments' histograms tell in which short time range it lies; only that range is read, and only from the
    segments that have points in it. Expired points, as far as they are still stored, are older than the window.
    """
    edge = window_edge([s.times for s in segments], size)
    if edge is None:
        return None
    return cut_at_rank(key_rows(edge_points(state, segments, edge.low_us, edge.high_us)), edge.rank)


def edge_points(state: WindowState, segments, low_us: int | None, high_us: int | None) -> DataFrame:
    """Stored points of a time range, or those without a time."""
    rows = state.points([s for s in segments if s.may_hold(low_us, high_us)])
    if low_us is None:
        return rows.where("ts is null")
    low, high = (F.timestamp_micros(F.lit(us)) for us in (low_us, high_us))
    return rows.where((F.col("ts") >= low) & (F.col("ts") < high))


def _gone_points(state: WindowState, before: Manifest, after: Manifest, new: Segment | None) -> DataFrame | None:
    """Points of the last window or the new segment that the window does not hold; None if there are none.

    Only segments that the new cut touches are read.
    """
    if after.cut is None:
        return None
    kept = F.coalesce(after.cut.kept(), F.lit(False))
    parts = []
    if after.cut != before.cut:
        touched = [s for s in before.points if s.times.nulls or s.first_us is None or s.first_us <= after.cut.ts_us]
        if touched:
            parts.append(state.window(replace(before, points=tuple(touched))).where(~kept))
    if new and (new.times.nulls or new.first_us is None or new.first_us <= after.cut.ts_us):
        parts.append(state.points([new]).where(~kept))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else (parts[0] if parts else None)


def _updated_trees(
    state: WindowState, before: Manifest, after: Manifest, new: Segment | None, batch_id: int, params: Params
) -> tuple[Manifest, DataFrame]:
    """Code changes and cells of the new window, from those of the last one and the points that came or went.

    No segment of points is read but the new one and those that lose points. Of the codes, only the coarse
    cells with an over-full leaf are.
    """
    version = f"v={batch_id}"
    fresh = before.cells is None or (before.n and not before.codes)
    if fresh:
        changes = code_counts(code_points(state.window(after), params))
    else:
        changes = code_counts(code_points(state.points([new] if new else []), params))
        gone = _gone_points(state, before, after, new)
        if gone is not None:
            left = code_counts(code_points(gone, params)).withColumn("n", -F.col("n"))
            changes = changes.unionByName(left).groupBy("tree", "code").agg(F.sum("n").alias("n"))
    made = state.write_codes(changes, params.max_depth, f"b={batch_id}")
    codes = (() if fresh else before.codes) + ((made,) if made else ())
    changes = state.codes((made,) if made else ())
    after = replace(after, codes=codes, cells=f"{version}/cells")
    if fresh:
        return after, write_table(build_cells(code_leaves(changes.drop("part"), params), params), f"{state.path}/{after.cells}")

    cells = state.cells(before)
    located = locate(changes.drop("part"), leaf_cells(cells), params)
    counted = apply_deltas(cells, path_deltas(located))
    trimmed = write_table(trim_cells(counted, params), f"{state.path}/{version}/trimmed")
    parts = coarse_parts(cells_to_split(trimmed, params), params)
    if not parts:
        return replace(after, cells=f"{version}/trimmed"), trimmed
    split = split_cells(trimmed, state.window_codes(codes, parts), params)
    return after, write_table(split, f"{state.path}/{after.cells}")


def coarse_parts(cells: DataFrame, params: Params) -> list[int]:
    """The coarse cells that hold or lie in some cells; at most 4^COARSE."""
    coarse = min(COARSE, params.max_depth)
    level, cell = F.col("level"), F.col("cell")
    below = F.call_function("shiftright", cell, (2 * F.greatest(level - coarse, F.lit(0))).cast("int"))
    up = (2 * F.greatest(coarse - level, F.lit(0))).cast("int")
    first = F.call_function("shiftleft", below, up)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), up)
    found = cells.select(F.explode(F.sequence(first, first + width - 1)).alias("part")).distinct()
    return sorted(r["part"] for r in found.collect())


def advance_window(
    batch: DataFrame,
    batch_id: int,
    state: WindowState,
    params: Params,
    options: StreamOptions,
    previous: int | None = None,
) -> None:
    """Take one micro-batch into the window, bring the trees up to date, score and report.

    ``previous`` is the batch before, where numbers have gaps. All results go to the state folder; running a
    batch again replaces them.
    """
    started = time.monotonic()
    previous = batch_id - 1 if previous is None else previous
    before = state.read_manifest(previous)
    points = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
    if options.clock == "arrival":
        # Later than any earlier stamp, so that time orders the batches.
        stamp = max(_micros_now(), (before.newest_us or 0) + 1)
        points = stamp_batch(with_ids(points), F.timestamp_micros(F.lit(stamp)))
    new = state.write_points(dedup_batch(points), f"b={batch_id}")
    after = next_manifest(state, before, new, params, options)

    version = state.version(batch_id)
    came = state.window(replace(after, points=(new,) if new else ()))
    if options.mode == "incremental":
        after, cells = _updated_trees(state, before, after, new, batch_id, params)
        made = {s.name for s in after.codes}
        codes = code_counts(code_points(came, params)) if options.scope == "batch" else state.window_codes(after.codes)
        codes = by_code = write_table(locate(codes, leaf_cells(cells), params), f"{version}/codes")
    else:
        made = set()
        codes = by_code = write_table(code_leaves(code_counts(code_points(state.window(after), params)), params), f"{version}/codes")
        cells = write_table(build_cells(by_code, params), f"{version}/cells")
        after = replace(after, cells=f"v={batch_id}/cells")
    # A path score needs no cell off the path; the box score also looks at cells beside it.
    near = cells_on_paths(cells, by_code) if options.scope == "batch" and params.scorer == "path" else cells
    leaf_scores = write_table(score_leaves(near, params), f"{version}/leaf_scores")

    coded = code_points(came if options.scope == "batch" else state.window(after), params)
    by_score = score_codes(by_code, leaf_scores, params)
    write_scores(score_coded(coded, by_score, hot_codes(codes, params.trees), params), state.path, batch_id)
    seconds = int(time.monotonic() - started)
    write_metrics(batch_metrics(after.n, cells, params, batch_id, seconds), state.path, batch_id)

    # Written segments that are merged here at once are needed by no version.
    written = {f"points/{new.name}"} if new else set()
    written |= {f"codes/{name}" for name in made}
    limit = params.window_size if params.window_type == "count" else after.n
    merged_points = state.compact_points(after.points, after.cut, batch_id, limit)
    merged_codes = state.compact_codes(after.codes, params.max_depth, batch_id)
    written |= {f"points/m={batch_id}_{t}" for t in range(max((s.tier for s in merged_points), default=0))}
    written |= {f"codes/m={batch_id}_{t}" for t in range(max((s.tier for s in merged_codes), default=0))}
    state.finish(before, replace(after, points=merged_points, codes=merged_codes), batch_id, previous, written)


def run_stream(
    points: DataFrame,
    path: str,
    params: Params,
    options: StreamOptions | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the pipeline on a stream of points; ``path`` is a shared folder for all state.

    Restarting with the same folder continues after the last finished batch.
    ``available_now`` processes the waiting files, one per batch, and stops.
    """
    options = options or StreamOptions()

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        advance_window(batch, batch_id, WindowState(batch.sparkSession, path), params, options)

    writer = points.writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", f"{path.rstrip('/')}/checkpoint"
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{options.trigger_seconds} seconds").start()


def run_folders(
    spark: SparkSession,
    source: str,
    path: str,
    params: Params,
    options: StreamOptions | None = None,
    batches: int | None = None,
    wait: bool = False,
    on_error: str = "fail",
) -> WindowState:
    """Process the batches ``batch_<i>.txt`` or ``batch_<i>/`` of a folder in order of their numbers.

    A folder is one batch, whatever number of files it has, once its writer has marked it complete with a
    ``_SUCCESS`` file. Numbers are kept; the state itself tells which ones are done, so a restart goes on where the
    last run ended. Stops after ``batches`` batches, or once none is left unless ``wait`` looks again after
    each ``trigger_seconds``.
    """
    options = options or StreamOptions()
    state = WindowState(spark, path)
    done = 0
    while batches is None or done < batches:
        last = state.latest()
        started = time.monotonic()
        waiting = [(i, name) for i, name in batch_folders(spark, source) if last is None or i > last]
        if waiting:
            number, name = waiting[0]
            batch = read_batch_folder(spark, f"{source.rstrip('/')}/{name}", on_error)
            advance_window(batch, number, state, params, options, -1 if last is None else last)
            done += 1
        elif not wait:
            break
        if wait:
            time.sleep(max(0.0, options.trigger_seconds - (time.monotonic() - started)))
    return state


def replay(
    points: DataFrame, batch_ids: list[int], path: str, params: Params, options: StreamOptions | None = None
) -> WindowState:
    """Run the same steps over the batches of a stored table, in the given order."""
    options = options or StreamOptions(clock="event")
    state = WindowState(points.sparkSession, path)
    for number, batch_id in enumerate(batch_ids):
        advance_window(points.where(F.col("batch_id") == batch_id), number, state, params, options)
    return state
