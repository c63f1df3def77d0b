"""Column expressions of the normalised deviation scores.

Both scores have the shape (expected count - own count) / spread, where expected count
and spread are count-weighted over a set of cells: the path from the root for the path
score, a frontier of cells for the box score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
COUNT = "decimal(19,0)"

# Path counts up to this fit 64-bit arithmetic, which gives the same numbers as decimals.
LONG_BELOW = 50_000_000
# Cubes are summed as multiples of this and a rest.
CUBE_UNIT = 10**18


def path_score(path: Column, exact: bool = False) -> Column:
    """Deviation of a leaf from the counts on its path (root first, leaf last).

    The root count only enters through the single-occupancy test. The default form
    truncates the two quotients under the root as integers do; ``exact`` keeps them real.
    """
    below_root = F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))
    sums = F.struct(
        below_root.alias("counts"),
        path[0].alias("root"),
        F.element_at(path, -1).alias("own"),
        _total(below_root, "bigint", lambda c: c).alias("s1"),
        _total(below_root, "double", lambda c: c.cast("double") * c.cast("double")).alias("real_s2"),
    )
    return _let(sums, lambda s: _path_score_of(s, exact))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value, so that it is computed once per row (by way of a one-element array)."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column, kind: str, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda acc, c: (acc + term(c)).cast(kind))


def _path_score_of(s: Column, exact: bool) -> Column:
    counts, own, s1 = s["counts"], s["own"].cast("double"), s["s1"].cast("double")
    largest = counts[0]

    def real_variance(mean: Column) -> Column:
        def term(c: Column) -> Column:
            gap = c.cast("double") - mean
            return c.cast("double") * gap * gap

        return _total(counts, "double", term) / s1

    def score(mean: Column, variance: Column) -> Column:
        ratio = F.when(variance > 0, (mean - own) / F.sqrt(variance)).otherwise(0.0)
        return F.greatest(ratio, F.lit(0.0))

    def truncated(kind: str) -> Column:
        """Score in whole numbers of the given type, or zero for single occupancy."""

        def of_sum(s2: Column) -> Column:
            whole = s["s1"].cast(kind)
            variance = _mean_square(counts, whole, kind) - _square_of_ratio(s2, whole, kind)
            mean = s2.cast("double") / s1
            return F.when(s2 == s["root"], 0.0).otherwise(score(mean, variance.cast("double")))

        square = _total(counts, kind, lambda c: c.cast(_factor(kind)) * c.cast(_factor(kind)))
        return _let(square, of_sum)

    real_mean = s["real_s2"] / s1
    real = _let(real_variance(real_mean), lambda variance: score(real_mean, variance))
    if exact:
        # s2 equals the root count only where both are small enough to be exact.
        value = F.when(s["real_s2"] == s["root"], 0.0).otherwise(real)
    else:
        value = F.when(largest <= LONG_BELOW, truncated("bigint")).otherwise(truncated(WIDE))
    return F.when((F.size(counts) == 0) | (s["s1"] == 0), 0.0).otherwise(value)


def _factor(kind: str) -> str:
    return "bigint" if kind == "bigint" else COUNT


def _div(a: Column, b: Column, kind: str) -> Column:
    """Truncating quotient; the quotients used here fit 64 bits."""
    return F.call_function("div", a, b).cast(kind)


def _mean_square(counts: Column, s1: Column, kind: str) -> Column:
    """floor(sum(c^3) / s1) without forming c^3; as decimals for counts up to about 10^16.

    With c^2 = q*s1 + r, c^3 / s1 = q*c + r*c/s1.
    """

    def square(c: Column) -> Column:
        return c.cast(_factor(kind)) * c.cast(_factor(kind))

    whole = _total(counts, kind, lambda c: (_div(square(c), s1, kind) * c).cast(kind))
    rest = _total(counts, kind, lambda c: ((square(c) % s1) * c).cast(kind))
    return (whole + _div(rest, s1, kind)).cast(kind)


def _square_of_ratio(s2: Column, s1: Column, kind: str) -> Column:
    """floor(s2^2 / s1^2) without forming s2^2.

    With s2 = q*s1 + r and 2*q*r = a*s1 + b, it is q^2 + a + floor((b*s1 + r^2) / s1^2).
    """
    q, r = _div(s2, s1, kind), (s2 % s1).cast(kind)
    twice = (q * r * 2).cast(kind)
    a, b = _div(twice, s1, kind), (twice % s1).cast(kind)
    carry = _div((b * s1 + r * r).cast(kind), (s1 * s1).cast(kind), kind)
    return ((q * q).cast(kind) + a + carry).cast(kind)


def cube_sums(count: Column) -> list[Column]:
    """Aggregates ``s3_high`` and ``s3_low``: the sum of cubes is s3_high * CUBE_UNIT + s3_low."""
    square = (count * count).cast(WIDE)
    low = (square % F.lit(CUBE_UNIT)).cast(WIDE)
    high = F.call_function("div", square, F.lit(CUBE_UNIT)).cast(COUNT)
    return [
        F.sum((high * count).cast(WIDE)).cast(WIDE).alias("s3_high"),
        F.sum((low.cast(COUNT) * count).cast(WIDE)).cast(WIDE).alias("s3_low"),
    ]


def whole_cubes(high: Column, low: Column) -> Column:
    """The sum of cubes, NULL where 38 digits do not hold it."""
    return F.try_add(F.try_multiply(high, F.lit(CUBE_UNIT).cast(COUNT)), low).cast(WIDE)


def mdef_norm(
    n_sampling: Column, s2: Column, s3: Column, n_counting: Column, s3_high: Column | int = 0
) -> Column:
    """Deviation of a counting cell inside a sampling cell.

    ``s2`` and s3_high * CUBE_UNIT + ``s3`` are sums of squares and cubes of the frontier
    counts below the sampling cell. One form for all sizes, up to 10^15 points.
    """
    n, q = n_sampling.cast("double"), s2.cast("double")
    high = F.lit(s3_high) if isinstance(s3_high, int) else s3_high
    spread = _spread(n_sampling.cast(COUNT), s2, high.cast(WIDE), s3)
    score = F.when(spread > 0, (q / n - n_counting.cast("double")) / spread).otherwise(0.0)
    return F.when(n_sampling == s2, 0.0).otherwise(score)


def _spread(n: Column, s2: Column, s3_high: Column, s3_low: Column) -> Column:
    """sqrt(s3/n - (s2/n)^2) with the large whole parts subtracted exactly.

    With s3 = q*n + r and s2 = p*n + t, the variance is
    (q - p^2) + (r - 2*p*t)/n - (t/n)^2.
    """
    real, unit = n.cast("double"), F.lit(CUBE_UNIT).cast(COUNT)
    a, h = _quotient(s3_high, n)
    b, r = _quotient((h * unit + s3_low).cast(WIDE), n)
    q = (a * unit + b).cast(WIDE)
    p, t = _quotient(s2, n)
    variance = (
        (q - p * p).cast("double")
        + (r - p * t * 2).cast("double") / real
        - (t.cast("double") / real) * (t.cast("double") / real)
    )
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


def _quotient(a: Column, n: Column) -> tuple[Column, Column]:
    """Whole quotient and rest of decimals."""
    rest = (a % n).cast(WIDE)
    return ((a - rest) / n).cast(WIDE), rest
