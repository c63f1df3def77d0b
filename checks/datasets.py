"""Point sets taken from the given tables, and the parameters they are checked with."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscan.config import Domain, Params
from gridscan.operators.batch import dedup_batch
from gridscan.plans.tables import CHECKPOINT_CONF, shared_dir
from gridscan.sources.points import points_from

# Shifts that do not line up with the cells, so distances do not tie.
SHIFTS = ((0.0, 0.0), (700.3, 123.7), (1211.9, 640.1), (333.3, 401.9))
EVENTS_DOMAIN = Domain(0, 0, 2048, 1024)
NARROW_DOMAIN = Domain(16, 8, 80, 136)  # part of the events lies outside
LINEITEM_DOMAIN = Domain(0, 0, 64, 131072)
EMBEDDING_DOMAIN = Domain(-1, -1, 1, 1)
DEPTH = 16

ONE = Params(max_depth=DEPTH, domain=EVENTS_DOMAIN)
FOUR = Params(max_depth=DEPTH, domain=EVENTS_DOMAIN, trees=4, grids=SHIFTS)
NARROW = Params(max_depth=DEPTH, domain=NARROW_DOMAIN)
LINEITEM = Params(max_depth=DEPTH, domain=LINEITEM_DOMAIN)
LINEITEM_SHIFTS = ((0.0, 0.0), (21.7, 15837.3), (37.9, 82011.1), (10.3, 51444.4))
LINEITEM_FOUR = Params(max_depth=DEPTH, domain=LINEITEM_DOMAIN, trees=4, grids=LINEITEM_SHIFTS)
DRAWN = Params(max_depth=DEPTH, domain=EVENTS_DOMAIN, trees=6, seed=7)
EMBEDDING = Params(max_depth=DEPTH, domain=EMBEDDING_DOMAIN, neighborhood_size=10)

FIRST_DAY = "2024-01-01"


def work_folder(spark: SparkSession) -> str:
    """A new folder of the session's shared one; in local mode without one, a temporary folder."""
    if not spark.conf.get(CHECKPOINT_CONF, None) and re.match(r"local(\[[^-]|$)", spark.sparkContext.master):
        return f"{tempfile.mkdtemp(prefix='gridscan-')}/{uuid.uuid4().hex}"
    return shared_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str, days_per_batch: int | None = None) -> DataFrame:
    """Events as points, as one batch or with one batch per so many days."""
    events = table(spark, sf_dir, "events")
    batch = 0
    if days_per_batch:
        day = F.date_diff(F.col("ts").cast("date"), F.lit(FIRST_DAY).cast("date"))
        batch = F.floor(day / days_per_batch)
    return points_from(events, "user_id", "value", "event_id", batch, "ts")


def events(spark: SparkSession, sf_dir: str, days_per_batch: int | None = None) -> DataFrame:
    return dedup_batch(raw_events(spark, sf_dir, days_per_batch))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (quantity, price); the table has no key, so one is built from the two values."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice").distinct()
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    key = F.round(F.col("l_quantity")).cast("long") * 100_000_000 + cents
    return points_from(rows, "l_quantity", "l_extendedprice", key)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return dedup_batch(
        points_from(rows, F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), "vec_id")
    )
