"""Counts of points over time that can be merged, to find where a count window ends without reading it.

A histogram has at most ``BUCKETS`` buckets of 2^shift microseconds, aligned to zero, so that two
histograms merge exactly after the finer one is coarsened. Points without a time are counted apart; they are
older than all others.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


@dataclass(frozen=True)
class Edge:
    """Where the oldest point of a count window lies: as ``rank``-th newest of the ``n`` points in a time range.

    ``low_us`` is included and ``high_us`` not; both are None for the points without a time.
    """

    low_us: int | None
    high_us: int | None
    rank: int
    n: int


@dataclass(frozen=True)
class TimeHistogram:
    shift: int = 0
    counts: tuple[tuple[int, int], ...] = ()
    nulls: int = 0

    @property
    def total(self) -> int:
        return self.nulls + sum(n for _, n in self.counts)

    def coarser(self, shift: int) -> TimeHistogram:
        sums: Counter = Counter()
        for bucket, n in self.counts:
            sums[bucket >> (shift - self.shift)] += n
        return TimeHistogram(shift, tuple(sorted(sums.items())), self.nulls)


def shift_for(low_us: int, high_us: int) -> int:
    """The finest bucket width that takes at most ``BUCKETS`` buckets for a range."""
    shift = 0
    while (high_us >> shift) - (low_us >> shift) >= BUCKETS:
        shift += 1
    return shift


def merged(histograms: list[TimeHistogram]) -> TimeHistogram:
    """The histogram of all points of several."""
    times = [(h.counts[0][0] << h.shift, h.counts[-1][0] << h.shift) for h in histograms if h.counts]
    shift = max((h.shift for h in histograms if h.counts), default=0)
    if times:
        shift = max(shift, shift_for(min(low for low, _ in times), max(high for _, high in times)))
    sums: Counter = Counter()
    for histogram in histograms:
        sums.update(dict(histogram.coarser(shift).counts) if histogram.counts else {})
    return TimeHistogram(shift, tuple(sorted(sums.items())), sum(h.nulls for h in histograms))


def window_edge(histograms: list[TimeHistogram], size: int) -> Edge | None:
    """Where the ``size``-th newest point is; None if there are no more points than that.

    Histograms stay as fine as the coarsest of them; they need not fit ``BUCKETS`` together.
    """
    if sum(h.total for h in histograms) <= size:
        return None
    shift = max((h.shift for h in histograms if h.counts), default=0)
    sums: Counter = Counter()
    for histogram in histograms:
        sums.update(dict(histogram.coarser(shift).counts) if histogram.counts else {})
    rank = size
    for bucket, n in sorted(sums.items(), reverse=True):
        if rank <= n:
            return Edge(bucket << shift, (bucket + 1) << shift, rank, n)
        rank -= n
    return Edge(None, None, rank, sum(h.nulls for h in histograms))


def histogram_of(points: DataFrame, low_us: int | None, high_us: int | None, n: int, nulls: int) -> TimeHistogram:
    """The histogram of points whose number and time range are known; one aggregation unless all times are equal."""
    if low_us is None or high_us is None:
        return TimeHistogram(nulls=nulls)
    if low_us == high_us:
        return TimeHistogram(0, ((low_us, n - nulls),), nulls)
    shift = shift_for(low_us, high_us)
    bucket = F.call_function("shiftright", F.unix_micros("ts"), F.lit(shift))
    rows = points.where("ts is not null").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # At most BUCKETS rows.
    return TimeHistogram(shift, tuple(sorted((r["bucket"], r["n"]) for r in rows.collect())), nulls)
