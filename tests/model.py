"""A small model in plain Python of what the jobs compute, one window and one tree at a time."""

from __future__ import annotations

import math
from collections import Counter


def code(x, y, params, shift=(0.0, 0.0)):
    d, side = params.domain, 1 << params.max_depth
    if not (d.x_min <= x <= d.x_max and d.y_min <= y <= d.y_max):
        return None
    index = []
    for v, low, width, s in ((x, d.x_min, d.width, shift[0]), (y, d.y_min, d.height, shift[1])):
        u = (v - low) + s
        if s > 0 and u >= width:
            u -= width
        index.append(min(math.floor(u / width * side), side - 1))
    return sum(((index[0] >> k) & 1) << (2 * k) | ((index[1] >> k) & 1) << (2 * k + 1) for k in range(params.max_depth))


def tree(codes, params):
    """{(level, cell): (n, is_leaf)} over a list of codes."""
    depth, many = params.max_depth, params.neighborhood_size
    counts = Counter((level, c >> (2 * (depth - level))) for c in codes for level in range(depth + 1))
    cells, todo = {}, [(0, 0)]
    while todo:
        level, cell = todo.pop()
        n = counts[(level, cell)]
        internal = n > many and level < depth
        cells[(level, cell)] = (n, not internal)
        if internal:
            todo.extend((level + 1, cell * 4 + digit) for digit in range(4))
    return cells


def leaf_of(c, cells, params):
    for level in range(params.max_depth + 1):
        cell = c >> (2 * (params.max_depth - level))
        if cells[(level, cell)][1]:
            return level, cell
    raise AssertionError("no leaf")


def path_score(path, exact=False):
    counts, root = path[1:], path[0]
    s1, s2, s3 = sum(counts), sum(c * c for c in counts), sum(c**3 for c in counts)
    if not counts or s1 == 0 or s2 == root:
        return 0.0
    variance = (s3 * s1 - s2 * s2) / (s1 * s1) if exact else s3 // s1 - (s2 * s2) // (s1 * s1)
    return max(0.0, (s2 / s1 - counts[-1]) / math.sqrt(variance)) if variance > 0 else 0.0


def leaf_path_score(leaf, cells):
    level, cell = leaf
    return path_score([cells[(k, cell >> (2 * (level - k)))][0] for k in range(level + 1)])
