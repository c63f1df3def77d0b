"""Suffix sorting by linear grouping, for many independent blocks of short texts at once.

First phase: the suffixes of a block are grouped by their first symbol, and groups are taken from the
largest to the smallest. For every suffix of a group its previous smaller pointer is found: the nearest
position before it in its text whose group is still smaller. The contexts at those positions are extended by
the group's context, as often as it follows there, and positions with more repeats go to a new, larger group
just behind their old one. In the end a group holds the suffixes with one Lyndon prefix, and groups are in
the order of those. Blocks do not depend on each other, so one step takes the next group of every block.

Second phase: a suffix is its Lyndon prefix followed by a smaller suffix. Taking suffixes in ascending
order, each puts those that it follows into the next free place of their groups. Nothing is renamed and
there is no recursion.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class _Groups:
    """The groups of all blocks: linked lists within a block, members in one pool that only grows."""

    def __init__(self, symbols: np.ndarray, block: np.ndarray, inside: np.ndarray):
        n = len(symbols)
        order = inside[np.lexsort((symbols[inside], block[inside]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
        first = np.flatnonzero(new)
        self.made = len(first)
        room = self.made + len(inside)  # a position moves once for each time that it is a pointer's target
        self.start = np.zeros(room, dtype=np.int64)
        self.count = np.zeros(room, dtype=np.int64)
        self.length = np.ones(room, dtype=np.int64)
        self.before = np.full(room, -1, dtype=np.int64)
        self.after = np.full(room, -1, dtype=np.int64)
        self.start[: self.made] = first
        self.count[: self.made] = np.diff(np.append(first, len(order)))
        owner = block[order[first]]
        linked = np.flatnonzero(owner[1:] == owner[:-1])
        self.before[linked + 1] = linked
        self.after[linked] = linked + 1
        self.top = np.flatnonzero(np.append(owner[1:] != owner[:-1], np.ones(min(1, self.made), dtype=bool)))
        self.pool = np.zeros(2 * len(inside), dtype=np.int64)
        self.pool[: len(order)] = order
        self.used = len(order)
        self.of = np.full(n, -1, dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1

    def members(self, groups: np.ndarray) -> np.ndarray:
        found = self.pool[_ranges(self.start[groups], self.count[groups])]
        return found[self.of[found] == np.repeat(groups, self.count[groups])]

    def move(self, positions: np.ndarray, repeats: np.ndarray, added: np.ndarray) -> None:
        """Positions go behind their groups, those of more repeats of the added length farther."""
        order = np.lexsort((repeats, self.of[positions]))
        positions, repeats, added = positions[order], repeats[order], added[order]
        old = self.of[positions]
        new = np.ones(len(old), dtype=bool)
        new[1:] = (old[1:] != old[:-1]) | (repeats[1:] != repeats[:-1])
        first = np.flatnonzero(new)
        ids = self.made + np.arange(len(first))
        self.of[positions] = self.made + np.cumsum(new) - 1
        self.pool[self.used : self.used + len(positions)] = positions
        self.start[ids] = self.used + first
        self.count[ids] = np.diff(np.append(first, len(old)))
        self.length[ids] = self.length[old[first]] + repeats[first] * added[first]
        self.used += len(positions)
        self.made += len(ids)
        old = old[first]
        head = np.ones(len(old), dtype=bool)
        head[1:] = old[1:] != old[:-1]
        tail = np.append(head[1:], True)
        behind = self.after[old[tail]]
        self.before[ids] = np.where(head, old, ids - 1)
        self.after[ids[~tail]] = ids[~tail] + 1
        self.after[ids[tail]] = behind
        self.after[old[head]] = ids[head]
        self.before[behind[behind >= 0]] = ids[tail][behind >= 0]


def _lyndon_groups(symbols: np.ndarray, block: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of its Lyndon prefix and the step at which its group was taken."""
    groups = _Groups(symbols, block, inside)
    smaller = np.arange(-1, len(symbols) - 1)  # the previous smaller pointer, once a position is done
    done = np.zeros(len(symbols), dtype=bool)
    taken = np.zeros(len(symbols), dtype=np.int64)
    current, step = groups.top, 0
    while len(current):
        members = groups.members(current)
        taken[members] = step
        done[members] = True
        target = smaller[members]
        open_ = np.flatnonzero(done[target])
        while len(open_):  # pointers of one group shorten each other's way
            target[open_] = smaller[target[open_]]
            smaller[members[open_]] = target[open_]
            open_ = open_[done[target[open_]]]
        found = np.flatnonzero(symbols[target])
        if len(found):
            positions, first, repeats = np.unique(target[found], return_index=True, return_counts=True)
            groups.move(positions, repeats, groups.length[groups.of[members[found[first]]]])
        current = groups.before[current]
        current = current[current >= 0]
        step += 1
    return groups.length[groups.of], taken


def suffix_order(symbols: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The positions of texts by block and, within a block, in ascending order of their suffixes.

    symbols: the texts with a 0 before the first and after each of them; other symbols are positive.
    block: the block of each position. Suffixes end with their text; equal ones stand in any order.
    """
    inside = np.flatnonzero(symbols)
    if not len(inside):
        return inside
    length, taken = _lyndon_groups(symbols, block, inside)
    by_group = inside[np.lexsort((-taken[inside], block[inside]))]
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (taken[by_group[1:]] != taken[by_group[:-1]]) | (block[by_group[1:]] != block[by_group[:-1]])
    group = np.zeros(len(symbols), dtype=np.int64)
    group[by_group] = np.cumsum(new) - 1
    rest = inside + length[inside]  # where the smaller suffix behind the Lyndon prefix starts
    chained = np.argsort(rest, kind="stable")
    behind, rest = inside[chained], rest[chained]
    other = np.ones(len(rest), dtype=bool)
    other[1:] = rest[1:] != rest[:-1]
    follower = np.full(len(symbols), -1, dtype=np.int64)  # the first suffix that a position follows
    follower[rest[other]] = behind[other]
    sibling = np.full(len(symbols), -1, dtype=np.int64)
    sibling[behind[:-1][~other[1:]]] = behind[1:][~other[1:]]
    # The second phase reads its own output in order, so it is a plain loop over whole numbers.
    follower, sibling, group, free = (a.tolist() for a in (follower, sibling, group, np.flatnonzero(new)))
    order = [0] * len(inside)
    for s in behind[symbols[rest] == 0].tolist():
        order[free[group[s]]] = s
        free[group[s]] += 1
    for at in range(len(order)):
        s = follower[order[at]]
        while s >= 0:
            order[free[group[s]]] = s
            free[group[s]] += 1
            s = sibling[s]
    return np.array(order, dtype=np.int64)


def suffix_array(data: bytes | np.ndarray) -> list[int]:
    """Starts of all suffixes of one text in ascending order."""
    symbols = np.zeros(len(data) + 2, dtype=np.int64)
    symbols[1:-1] = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
    symbols[1:-1] += 1
    return (suffix_order(symbols, np.zeros(len(symbols), dtype=np.int64)) - 1).tolist()
