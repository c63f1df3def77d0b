"""Parameters of a detector run, validated once on construction."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

# The default workload.
DEFAULT_WINDOW_SIZE = 10_000_000
DEFAULT_TREES = 1
DEFAULT_ALPHA = 4
DEFAULT_NEIGHBORHOOD_SIZE = 40
DEFAULT_MAX_DEPTH = 20
DEFAULT_TRIGGER_SECONDS = 30
MAX_DEPTH = 30  # two bits per level have to fit a signed 64-bit code
MAX_TREES = 256  # bounds every per-tree broadcast and per-point array

WINDOW_TYPES = ("count", "time")
SCORERS = ("path", "box")


@dataclass(frozen=True)
class Domain:
    """Closed rectangle of valid coordinates; latitude and longitude by default."""

    x_min: float = -90.0
    y_min: float = -180.0
    x_max: float = 90.0
    y_max: float = 180.0

    def __post_init__(self) -> None:
        if not all(math.isfinite(v) for v in (self.x_min, self.y_min, self.x_max, self.y_max)):
            raise ValueError("domain bounds must be finite")
        if self.x_min >= self.x_max or self.y_min >= self.y_max:
            raise ValueError("domain must have min < max in both dimensions")

    @property
    def width(self) -> float:
        return self.x_max - self.x_min

    @property
    def height(self) -> float:
        return self.y_max - self.y_min


@dataclass(frozen=True)
class Params:
    """Settings of one detector.

    ``window_size`` counts points for a count window and seconds for a time window.
    ``grids`` lists explicit (sx, sy) shifts; without it, tree 0 is unshifted and the
    other ``trees - 1`` shifts are drawn uniformly from the domain by a hash of ``seed`` and tree.
    """

    window_type: str = "count"
    window_size: int = DEFAULT_WINDOW_SIZE
    trees: int = DEFAULT_TREES
    alpha: int = DEFAULT_ALPHA
    neighborhood_size: int = DEFAULT_NEIGHBORHOOD_SIZE
    max_depth: int = DEFAULT_MAX_DEPTH
    seed: int = 0
    grids: tuple[tuple[float, float], ...] | None = None
    domain: Domain = field(default_factory=Domain)
    scorer: str = "path"
    exact: bool = False

    def __post_init__(self) -> None:
        if self.window_type not in WINDOW_TYPES:
            raise ValueError(f"window_type must be one of {WINDOW_TYPES}")
        if self.scorer not in SCORERS:
            raise ValueError(f"scorer must be one of {SCORERS}")
        if self.window_size < 1:
            raise ValueError("window_size must be positive")
        if not 1 <= self.trees <= MAX_TREES:
            raise ValueError(f"trees must lie in 1..{MAX_TREES}")
        if self.alpha < 1:
            raise ValueError("alpha must be at least 1")
        if self.neighborhood_size < 1:
            raise ValueError("neighborhood_size must be at least 1")
        if not 1 <= self.max_depth <= MAX_DEPTH:
            raise ValueError(f"max_depth must lie in 1..{MAX_DEPTH}")
        if self.grids is not None:
            if len(self.grids) != self.trees:
                raise ValueError("grids must list one (sx, sy) shift per tree")
            for sx, sy in self.grids:
                if not (0 <= sx < self.domain.width and 0 <= sy < self.domain.height):
                    raise ValueError("a shift must lie in [0, domain width) per dimension")

    def shifts(self) -> list[tuple[float, float]]:
        """One (sx, sy) per tree, the same on every call."""
        if self.grids is not None:
            return [(float(sx), float(sy)) for sx, sy in self.grids]
        d = self.domain
        drawn = [
            (drawn_share(self.seed, tree, "x") * d.width, drawn_share(self.seed, tree, "y") * d.height)
            for tree in range(1, self.trees)
        ]
        return [(0.0, 0.0), *drawn]


def drawn_share(seed: int, tree: int, axis: str) -> float:
    """A number in [0, 1) that depends on nothing else: the first 52 bits of the MD5 of 'seed:tree:axis'."""
    return int(hashlib.md5(f"{seed}:{tree}:{axis}".encode()).hexdigest()[:13], 16) / (1 << 52)
