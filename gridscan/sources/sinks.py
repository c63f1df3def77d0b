"""Writers of results. Each replaces its batch's output, so a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_scores(scored: DataFrame, path: str, batch_id: int) -> None:
    """Scored points of the window as it was after a batch."""
    scored.write.mode("overwrite").parquet(f"{path}/scores/window={batch_id}")


def read_scores(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """All scored points with the column ``window``, or those of one batch's window."""
    if batch_id is not None:
        return spark.read.parquet(f"{path}/scores/window={batch_id}")
    return spark.read.parquet(f"{path}/scores")


def write_metrics(metrics: DataFrame, path: str, batch_id: int) -> None:
    """The metrics row of one batch."""
    metrics.coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics/window={batch_id}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of all batches so far: batch_id, window_count, avg_nodes, seconds."""
    return spark.read.parquet(f"{path}/metrics").select(
        "batch_id", "window_count", "avg_nodes", "seconds"
    )
