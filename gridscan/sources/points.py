"""Readers that produce points: point_id, batch_id, ts, x, y."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscan.plans import files

POINT_COLUMNS = ["point_id", "batch_id", "ts", "x", "y"]
# Fixed value: naming of batch files; a batch may also be a folder of part files.
BATCH_FILE = r"batch_(?:id=)?(\d+)(?:\.txt)?(?:/[^/]*)?$"


def parse_points(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """Turn the column ``value`` ('x,y[,ignored...]') into ``x`` and ``y``.

    A malformed or short line fails the job, or is dropped with ``on_error='drop'``.
    """
    if on_error not in ("fail", "drop"):
        raise ValueError("on_error must be 'fail' or 'drop'")
    fields = F.split("value", ",")
    if on_error == "drop":
        x, y = (F.get(fields, F.lit(i)).try_cast("double") for i in (0, 1))
    else:
        # element_at fails on a missing field and cast on a malformed one, also without ANSI.
        x, y = (_strict_double(F.get(fields, F.lit(i))) for i in (0, 1))
    parsed = lines.withColumns({"x": x, "y": y}).drop("value")
    return parsed.where(F.col("x").isNotNull() & F.col("y").isNotNull()) if on_error == "drop" else parsed


def _strict_double(text: Column) -> Column:
    value = text.try_cast("double")
    message = F.concat(F.lit("not a coordinate: "), F.coalesce(text, F.lit("missing field")))
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(message).cast("double"))


def read_points_text(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Read batch files ``batch_<i>.txt``; ``batch_id`` comes from the name.

    ``point_id`` is unique within one read; ``ts`` is left NULL until the batch is stamped.
    """
    lines = spark.read.text(path)
    points = _from_lines(lines.select("value", F.col("_metadata.file_path").alias("file")), on_error)
    return with_ids(points)


def with_ids(points: DataFrame) -> DataFrame:
    """Fill NULL ids with numbers unique within one evaluation of a static DataFrame."""
    number = F.coalesce(F.col("point_id"), F.monotonically_increasing_id())
    return points.withColumn("point_id", number)


def stream_points(
    spark: SparkSession, path: str, on_error: str = "fail", files_per_batch: int | None = 1
) -> DataFrame:
    """Stream the files of a folder, so many per micro-batch (None: all that wait), in order of arrival.

    ``point_id`` stays NULL until the micro-batch is processed; files without a number in
    their name have a NULL ``batch_id``.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(path)
    return _from_lines(lines.select("value", F.col("_metadata.file_path").alias("file")), on_error)


def batch_folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and name of each complete batch in a folder, by number.

    A batch is a file ``batch_<i>.txt``, or a folder ``batch_<i>`` (also with ``.txt``) that holds a ``_SUCCESS`` file.
    """
    found = []
    for name in files.names(spark, path):
        if match := re.search(BATCH_FILE, name):
            inside = f"{path.rstrip('/')}/{name}"
            if files.exists(spark, f"{inside}/_SUCCESS") or not files.is_folder(spark, inside):
                found.append((int(match[1]), name))
    numbers = [number for number, _ in found]
    if len(set(numbers)) < len(numbers):
        raise ValueError(f"two batches in {path} have the same number")
    return sorted(found)


def read_batch_folder(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """The points of one batch, a file or a folder of part files."""
    lines = spark.read.text(path)
    return with_ids(_from_lines(lines.select("value", F.col("_metadata.file_path").alias("file")), on_error))


def _from_lines(lines: DataFrame, on_error: str) -> DataFrame:
    number = F.regexp_extract("file", BATCH_FILE, 1)
    return parse_points(
        lines.select(
            F.lit(None).cast("long").alias("point_id"),
            F.when(number != "", number.cast("long")).alias("batch_id"),
            F.lit(None).cast("timestamp").alias("ts"),
            "value",
        ),
        on_error,
    ).select(*POINT_COLUMNS)


def points_from(
    table: DataFrame,
    x: Column | str,
    y: Column | str,
    point_id: Column | str,
    batch_id: Column | int = 0,
    ts: Column | str | None = None,
) -> DataFrame:
    """Take points from the columns of any DataFrame."""

    def column(value: Column | str) -> Column:
        return F.col(value) if isinstance(value, str) else value

    batch = F.lit(batch_id) if isinstance(batch_id, int) else batch_id
    stamp = F.lit(None) if ts is None else column(ts)
    return table.select(
        column(point_id).cast("long").alias("point_id"),
        batch.cast("long").alias("batch_id"),
        stamp.cast("timestamp").alias("ts"),
        column(x).cast("double").alias("x"),
        column(y).cast("double").alias("y"),
    )
