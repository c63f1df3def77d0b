"""Steps on a single micro-batch: arrival stamp and collapse of repeated coordinates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp_batch(points: DataFrame, arrival: datetime | Column) -> DataFrame:
    """Give all points of a batch the same arrival time."""
    value = arrival if isinstance(arrival, Column) else F.lit(arrival)
    return points.withColumn("ts", value.cast("timestamp"))


def dedup_batch(points: DataFrame) -> DataFrame:
    """Keep one point, the one with the smallest id, per coordinate pair and batch.

    An aggregate with map-side combine: a coordinate repeated in a third of the rows
    reaches its reducer as one row per map task.
    """
    payload = [c for c in points.columns if c not in ("batch_id", "x", "y")]
    first = F.min(F.struct("point_id", *[c for c in payload if c != "point_id"])).alias("first")
    kept = points.groupBy("batch_id", "x", "y").agg(first)
    return kept.select(
        *[F.col(c) if c in ("batch_id", "x", "y") else F.col("first")[c].alias(c) for c in points.columns]
    )


def duplicate_points(points: DataFrame) -> DataFrame:
    """Coordinates seen more than once in a batch, with their number of occurrences."""
    return (
        points.groupBy("batch_id", "x", "y")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )
