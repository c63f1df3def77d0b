"""Time the headline jobs and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import datasets as D
from gridscan.config import Params
from gridscan.operators.window import window_count
from gridscan.plans.detect import detect
from gridscan.streaming.run import StreamOptions, advance_window
from gridscan.streaming.state import WindowState

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
DAYS = 10  # days per micro-batch: three batches


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def scored(points: DataFrame, params: Params) -> None:
    consume(detect(points, params, D.work_folder(points.sparkSession)).points)


def batch_seconds(spark: SparkSession, mode: str) -> float:
    """Seconds of the last of three micro-batches, with a window of half the points."""
    raw = D.raw_events(spark, SF_DIR, DAYS)
    params = replace(D.ONE, window_size=raw.count() // 2)
    state = WindowState(spark, D.work_folder(spark))
    for number in range(3):
        start = time.monotonic()
        batch = raw.where(F.col("batch_id") == number)
        advance_window(batch, number, state, params, StreamOptions(clock="event", mode=mode))
    return time.monotonic() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("gridscan-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events, lineitem = D.events(spark, SF_DIR), D.lineitem(spark, SF_DIR)
    daily = D.events(spark, SF_DIR, 1)
    size = daily.count() // 4
    box = {"scorer": "box", "alpha": 4}
    jobs = {
        "score_events_path": lambda: scored(events, D.ONE),
        "score_events_path_4_trees": lambda: scored(events, D.FOUR),
        "score_events_box": lambda: scored(events, replace(D.ONE, **box)),
        "score_events_box_4_trees": lambda: scored(events, replace(D.FOUR, **box)),
        "score_lineitem_path": lambda: scored(lineitem, D.LINEITEM),
        "window_count": lambda: consume(window_count(daily, size)),
    }
    scored(events, D.ONE)  # start-up of the session is not measured
    seconds = {}
    for name, job in jobs.items():
        start = time.monotonic()
        job()
        seconds[name] = round(time.monotonic() - start, 3)
    for mode in ("recompute", "incremental"):
        seconds[f"batch_{mode}"] = round(batch_seconds(spark, mode), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
