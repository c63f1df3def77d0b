"""Streaming and batch outlier scoring of 2-D points over adaptive quadtree grids."""

from gridscan.config import Domain, Params

__all__ = ["Domain", "Params"]
