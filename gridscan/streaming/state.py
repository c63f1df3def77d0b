"""Window state between micro-batches, as versioned tables in a shared folder.

    points/<name>   a segment of points: one batch as it arrived, or several merged
    codes/<name>    a segment of signed changes to the points per code, sorted by tree and coarse cell
    v=<b>/...       the trees after batch b
    v=<b>/manifest  which segments make the window after batch b; written last

Segments are merged in tiers: ``FAN`` small ones of a tier become one of the next. A point is rewritten once
per tier, and the number of segments grows with the logarithm of the number of batches. Segments of points stop
growing at a share of the window, which bounds how many expired points they keep.

Batch b reads version b-1 and writes version b, replacing what an interrupted attempt may have left. Segments
that version b no longer needs are kept until version b+1 is complete, as version b may have to be made again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscan.operators.window import Cut
from gridscan.plans import files
from gridscan.streaming.histogram import TimeHistogram, histogram_of, merged

FAN = 8  # segments of a tier that are merged
WINDOW_SHARE = 4  # merged segments of points hold at most this fraction of a window
FILE_ROWS = 2_000_000  # rows per file of a segment, about
COARSE = 3  # level of the cells by which codes are sorted and picked

POINT_SCHEMA = T.StructType(
    [
        T.StructField("point_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
CODE_SCHEMA = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("part", T.LongType()),
        T.StructField("code", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
CELL_SCHEMA = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("cell", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("is_leaf", T.BooleanType()),
    ]
)
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("cut_id", T.LongType()),
        T.StructField("shift", T.IntegerType()),
        T.StructField("nulls", T.LongType()),
        T.StructField(
            "buckets",
            T.ArrayType(T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])),
        ),
    ]
)


@dataclass(frozen=True)
class Segment:
    """A stored part of the window; ``times`` and the range are those of points, also of expired ones."""

    name: str
    n: int
    tier: int = 0
    first_us: int | None = None
    last_us: int | None = None
    times: TimeHistogram = TimeHistogram()

    def may_hold(self, low_us: int | None, high_us: int | None) -> bool:
        """Whether it has points in a time range (low included), or without a time if both are None."""
        if low_us is None and high_us is None:
            return self.times.nulls > 0
        return self.first_us is not None and self.first_us < high_us and self.last_us >= low_us


@dataclass(frozen=True)
class Manifest:
    """Content of the window: ``n`` points, those of the segments less the ones older than ``cut``.

    ``codes`` are the segments of code changes (none unless trees are updated), ``cells`` the name of the
    table of cells, ``dropped`` the paths that only the version before needs.
    """

    points: tuple[Segment, ...] = ()
    cut: Cut | None = None
    n: int = 0
    codes: tuple[Segment, ...] = ()
    cells: str | None = None
    newest_us: int | None = None
    dropped: tuple[str, ...] = ()


class WindowState:
    """Reads and writes the versions of one stream's state."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def version(self, batch_id: int) -> str:
        return f"{self.path}/v={batch_id}"

    # Points

    def points(self, segments: list[Segment] | tuple[Segment, ...]) -> DataFrame:
        """Points of the given segments, without reading other folders."""
        return self._read("points", POINT_SCHEMA, segments)

    def _read(self, kind: str, schema: T.StructType, segments) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{s.name}" for s in segments])

    def window(self, manifest: Manifest) -> DataFrame:
        points = self.points(manifest.points)
        return points if manifest.cut is None else points.where(manifest.cut.kept())

    def write_points(self, points: DataFrame, name: str, tier: int = 0, known: TimeHistogram | None = None) -> Segment | None:
        """Store a segment; None if it has no points. ``known`` is its histogram if that is at hand."""
        us = F.unix_micros("ts")
        seen = Observation()
        rows = points.select(*POINT_SCHEMA.names).observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("ts").isNull()).alias("nulls"),
            F.min(us).alias("low"),
            F.max(us).alias("high"),
        )
        rows.write.mode("overwrite").parquet(f"{self.path}/points/{name}")
        got = seen.get
        if not got["n"]:
            files.remove(self.spark, f"{self.path}/points/{name}")
            return None
        segment = Segment(name, got["n"], tier, got["low"], got["high"])
        times = known or histogram_of(self.points([segment]), got["low"], got["high"], got["n"], got["nulls"])
        return replace(segment, times=times)

    def compact_points(self, segments: tuple[Segment, ...], cut: Cut | None, batch_id: int, limit: int) -> tuple[Segment, ...]:
        """Merge small segments tier by tier, without the points older than ``cut``."""
        tier = 0
        while any(s.tier >= tier for s in segments):
            small = sorted((s for s in segments if s.tier == tier), key=lambda s: s.n)[:FAN]
            if len(small) >= FAN and sum(s.n for s in small) * WINDOW_SHARE <= limit:
                rows = self.points(small)
                whole = cut is None or all(s.times.nulls == 0 and s.first_us > cut.ts_us for s in small)
                if not whole:
                    rows = rows.where(cut.kept())
                rows = rows.coalesce(-(-sum(s.n for s in small) // FILE_ROWS))
                known = merged([s.times for s in small]) if whole else None
                made = self.write_points(rows, f"m={batch_id}_{tier}", tier + 1, known)
                segments = tuple(s for s in segments if s not in small) + ((made,) if made else ())
            tier += 1
        return segments

    # Codes

    def codes(self, segments: tuple[Segment, ...]) -> DataFrame:
        """Signed changes of the points per code, with ``part``, the coarse cell."""
        return self._read("codes", CODE_SCHEMA, segments)

    def window_codes(self, segments: tuple[Segment, ...], parts: list[int] | None = None) -> DataFrame:
        """Points of the window per (tree, code); with ``parts``, of these coarse cells only."""
        rows = self.codes(segments)
        if parts is not None:
            rows = rows.where(F.col("part").isin(parts))
        return rows.groupBy("tree", "code").agg(F.sum("n").alias("n")).where("n != 0")

    def write_codes(self, changes: DataFrame, depth: int, name: str, tier: int = 0) -> Segment | None:
        seen = Observation()
        part = F.call_function("shiftright", F.col("code"), F.lit(2 * (depth - min(COARSE, depth))))
        rows = changes.where("n != 0").select("tree", part.alias("part"), "code", "n")
        rows = rows.sortWithinPartitions("part", "tree", "code").observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{self.path}/codes/{name}")
        n = seen.get["n"]
        if not n:
            files.remove(self.spark, f"{self.path}/codes/{name}")
            return None
        return Segment(name, n, tier)

    def compact_codes(self, segments: tuple[Segment, ...], depth: int, batch_id: int) -> tuple[Segment, ...]:
        """Merge changes tier by tier, and all of them once the smaller ones are as many as the largest.

        What came and went cancels out when the two meet, at the latest then.
        """
        tier = 0
        while any(s.tier >= tier for s in segments):
            small = tuple(s for s in segments if s.tier == tier)
            if len(small) >= FAN:
                made = self.write_codes(self.window_codes(small), depth, f"m={batch_id}_{tier}", tier + 1)
                segments = tuple(s for s in segments if s.tier != tier) + ((made,) if made else ())
            tier += 1
        largest = max(segments, key=lambda s: s.n, default=None)
        if len(segments) >= FAN // 2 and sum(s.n for s in segments) >= 2 * largest.n:
            top = max(s.tier for s in segments)
            made = self.write_codes(self.window_codes(segments), depth, f"all={batch_id}", top)
            segments = (made,) if made else ()
        return segments

    def cells(self, manifest_or_batch: Manifest | int) -> DataFrame:
        """The cells of the trees after a batch."""
        manifest = manifest_or_batch
        if isinstance(manifest, int):
            manifest = self.read_manifest(manifest)
        return self.spark.read.schema(CELL_SCHEMA).parquet(f"{self.path}/{manifest.cells}")

    # Versions

    def latest(self) -> int | None:
        """The newest complete version."""
        found = [int(name[2:]) for name in files.names(self.spark, self.path) if name.startswith("v=")]
        done = [b for b in found if files.exists(self.spark, f"{self.version(b)}/manifest/_SUCCESS")]
        return max(done, default=None)

    def read_manifest(self, batch_id: int) -> Manifest:
        """Manifest after a batch; the window before batch 0 is empty."""
        if batch_id < 0:
            return Manifest()
        path = f"{self.version(batch_id)}/manifest"
        if not files.exists(self.spark, f"{path}/_SUCCESS"):
            raise ValueError(f"no complete state after batch {batch_id} in {self.path}")
        # One row for the window, and a small one per segment.
        rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(path).collect()
        head = next(r for r in rows if r.kind == "window")
        segments = {"points": [], "codes": []}
        for r in rows:
            if r.kind in segments:
                times = TimeHistogram(r["shift"], tuple((b["bucket"], b["n"]) for b in r.buckets), r.nulls)
                segments[r.kind].append(Segment(r.name, r.n, r.tier, r.first_us, r.last_us, times))
        return Manifest(
            tuple(segments["points"]),
            None if head.cut_id is None else Cut(head.first_us, head.cut_id),
            head.n,
            tuple(segments["codes"]),
            head.name,
            head.last_us,
            tuple(r.name for r in rows if r.kind == "dropped"),
        )

    def write_manifest(self, manifest: Manifest, batch_id: int) -> None:
        cut = (manifest.cut.ts_us, manifest.cut.point_id) if manifest.cut else (None, None)
        rows = [("window", manifest.cells, 0, manifest.n, cut[0], manifest.newest_us, cut[1], 0, 0, [])]
        for kind, segments in (("points", manifest.points), ("codes", manifest.codes)):
            for s in segments:
                times = s.times
                rows.append((kind, s.name, s.tier, s.n, s.first_us, s.last_us, None, times.shift, times.nulls, list(times.counts)))
        rows += [("dropped", path, 0, 0, None, None, None, 0, 0, []) for path in manifest.dropped]
        self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{self.version(batch_id)}/manifest"
        )

    def finish(self, before: Manifest, after: Manifest, batch_id: int, previous: int, made: set[str]) -> None:
        """Write version ``batch_id`` and remove what neither it nor the version before needs.

        ``made`` are the segments that this batch wrote, some of which were merged again at once.
        """
        old, new = _paths(before), _paths(after)
        after = replace(after, dropped=tuple(sorted(old - new)))
        self.write_manifest(after, batch_id)
        for path in {*before.dropped, *(made - new - old)} - new:
            files.remove(self.spark, f"{self.path}/{path}")
        for name in files.names(self.spark, self.path):
            if name.startswith("v=") and int(name[2:]) not in (batch_id, previous) and int(name[2:]) < batch_id:
                files.remove(self.spark, f"{self.path}/{name}")


def _paths(manifest: Manifest) -> set[str]:
    return {f"points/{s.name}" for s in manifest.points} | {f"codes/{s.name}" for s in manifest.codes}
