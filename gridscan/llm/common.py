"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT = 1024  # a key with more than this fraction of the rows is joined by broadcast
ARROW_ROWS = 500  # rows per Arrow batch: very long texts stay within a worker's memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, since a row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def with_fields(df: DataFrame, result: Column, names: list[str]) -> DataFrame:
    """Add the named fields of a struct; they replace columns of the same name, in any case."""
    taken = {n.lower() for n in names}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    holder = f"_result_{uuid.uuid4().hex}"
    return df.select(*kept, result.alias(holder)).select(
        *kept, *(F.col(holder)[n].alias(n) for n in names)
    )


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; in local mode any folder is shared."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and re.match(r"local(\[[^-]|$)", context.master):
        base = _local_folder()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> SparkSession:
    """Prepare a session for the queries: workers find this package, and Arrow batches are small."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")
    small_batches(spark)
    return spark


def release() -> None:
    """Give back what a worker's Arrow buffers and arrays no longer use; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(maxsize=1)
def _trim():
    """The C library's function that returns freed memory to the system, where there is one."""
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except (OSError, TypeError):
        return None


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, total: int) -> DataFrame:
    """Join rows to a table of one row per key; keys with a large share of the rows are joined by broadcast.

    counts: the keys with ``n``, their number of rows. Fewer than ``HOT`` keys can be hot.
    """
    hot = counts.where(F.col("n") * HOT > total).select(*keys)
    few = F.broadcast(table.join(F.broadcast(hot), keys))
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys)
    return rows.join(few, keys).unionByName(rest)
