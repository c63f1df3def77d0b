"""Sliding retention windows: which points stay and which expire.

The count window never sorts the data. It looks for the one key (ts, point_id) that
separates the newest W points from the rest by narrowing key ranges with histograms of
at most ``BUCKETS`` rows, and then filters on that key. The filter is a literal
comparison, so it reaches the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
RANK_LIMIT = 100_000  # rows that one task may rank
FIRST = -(1 << 62)  # stands for a NULL time or id, which is older than all others


@dataclass(frozen=True)
class Cut:
    """Key of the oldest point inside the window; ``ts_us`` is in microseconds."""

    ts_us: int
    point_id: int

    def kept(self) -> Column:
        """True for points of the window, false or NULL for others."""
        last = F.coalesce(F.col("point_id"), F.lit(FIRST)) >= self.point_id
        if self.ts_us == FIRST:
            return F.col("ts").isNotNull() | last
        ts, edge = F.col("ts").cast("timestamp"), F.timestamp_micros(F.lit(self.ts_us))
        newer = (ts > edge) | ((ts == edge) & last)
        # The first conjunct is implied by the second; it is the part a scan can push down.
        return (ts >= edge) & newer


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _narrow(rows: DataFrame, key: str, rank: int) -> tuple[DataFrame, int, int, bool]:
    """Restrict rows to a key range that holds the row of the given rank from the top.

    Returns the rows, the rank inside them, their number, and whether one key value is left.
    """
    low, high, total = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    while total > RANK_LIMIT and low < high:
        width = (high - low) // BUCKETS + 1
        bucket = F.call_function("div", F.lit(high) - F.col(key), F.lit(width))
        histogram = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        # At most BUCKETS rows, whatever the input: the running total fits one task.
        running = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("bucket")))
        hit = running.where(F.col("upto") >= rank).orderBy("bucket").first()
        rank -= hit["upto"] - hit["n"]
        total = hit["n"]
        high = high - hit["bucket"] * width
        low = max(low, high - width + 1)
        rows = rows.where(F.col(key).between(low, high))
    return rows, rank, total, low == high


def key_rows(points: DataFrame) -> DataFrame:
    """The keys (us, point_id) of points; NULLs come before all values."""
    null = F.lit(FIRST)
    return points.select(F.coalesce(_micros(), null).alias("us"), F.coalesce("point_id", null).alias("point_id"))


def cut_at_rank(keys: DataFrame, rank: int) -> Cut:
    """The key of the ``rank``-th newest of these rows, which are more than that or as many."""
    rows, rank, total, single = _narrow(keys, "us", rank)
    if total > RANK_LIMIT and single:
        rows, rank, _, _ = _narrow(rows, "point_id", rank)
    order = Window.orderBy(F.col("us").desc(), F.col("point_id").desc())
    edge = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == rank).first()
    return Cut(edge["us"], edge["point_id"])


def newest_cut(points: DataFrame, size: int) -> Cut | None:
    """Key of the ``size``-th newest point by (ts, point_id); None if all points fit.

    Needs a unique (ts, point_id). Runs a few aggregations that each return one row.
    """
    keys = key_rows(points)
    return cut_at_rank(keys, size) if keys.count() > size else None


def window_count(points: DataFrame, size: int, cut: Cut | None = None) -> DataFrame:
    """The newest ``size`` points by (ts, point_id); a NULL is older than any value."""
    cut = cut or newest_cut(points, size)
    return points if cut is None else points.where(cut.kept())


def expired_count(points: DataFrame, size: int, cut: Cut | None = None) -> DataFrame:
    """The points that ``window_count`` drops."""
    cut = cut or newest_cut(points, size)
    return points.where(F.lit(False)) if cut is None else points.where(~F.coalesce(cut.kept(), F.lit(False)))


def _fresh(now: Column, seconds: int) -> Column:
    # 64-bit microseconds; |age| as clocks may run ahead.
    age = F.unix_micros(now.cast("timestamp")) - _micros()
    return F.abs(age) < F.lit(seconds).cast("long") * 1_000_000


def window_time(points: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Points less than ``seconds`` away from ``now``; without a time they have expired."""
    return points.where(_fresh(now, seconds))


def expired_time(points: DataFrame, now: Column, seconds: int) -> DataFrame:
    """The points that ``window_time`` drops."""
    return points.where(~F.coalesce(_fresh(now, seconds), F.lit(False)))
