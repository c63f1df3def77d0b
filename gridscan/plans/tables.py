"""Written tables in the cluster's shared folder, used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which has to be set."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return f"{base.rstrip('/')}/gridscan-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: short lineage, known size, prunable columns."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
