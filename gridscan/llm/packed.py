"""Packed blocks of hashed keys with their owners, for counting in how many owners a key occurs."""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal significance together: the high ones of small numbers then compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: memoryview, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(dtype).ravel()


def pack(tokens: np.ndarray, owner: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Sorted 48-bit tokens, the index of each one's owner, and the owners' classes and sizes."""
    used, index = np.unique(owner, return_inverse=True)
    high = (tokens >> U(16)).astype(np.uint32)
    steps = np.diff(high, prepend=np.uint32(0)).astype(np.uint32)
    head = np.array([len(tokens), len(used)], dtype=np.uint32).tobytes()
    low = (tokens & U(0xFFFF)).astype(np.uint16)
    return b"".join([
        head, classes[used].astype(np.int64).tobytes(), sizes[used].astype(np.uint32).tobytes(),
        _planes(steps), _planes(low), _planes(index.astype(np.uint32)),
    ])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens, class and set size of each token's owner."""
    n, owners = (int(x) for x in np.frombuffer(data, np.uint32, 2))
    view, at = memoryview(data), 8
    classes = np.frombuffer(view[at:], np.int64, owners)
    at += 8 * owners
    sizes = np.frombuffer(view[at:], np.uint32, owners)
    at += 4 * owners
    high = np.cumsum(_from_planes(view[at:], n, np.uint32).astype(U))
    at += 4 * n
    low = _from_planes(view[at:], n, np.uint16).astype(U)
    at += 2 * n
    index = _from_planes(view[at:], n, np.uint32)
    return (high << U(16)) | low, classes[index], sizes[index].astype(np.int64)


def slices(
    tokens: np.ndarray, owner: np.ndarray, classes: np.ndarray, sizes: np.ndarray, buckets: int
) -> list[tuple[int, bytes]]:
    """One packed block for each bucket, by ranges of the tokens."""
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    bucket = ((tokens >> U(16)) * U(buckets)) >> U(32)
    edges = np.searchsorted(bucket, np.arange(buckets + 1).astype(U))
    return [
        (b, pack(tokens[i:j], owner[i:j], classes, sizes)) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i
    ]


def shared_keys(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unpacked blocks the tokens that occur twice or more: tokens, owners, sizes, a row per token and owner, by token.

    The list of parts is emptied.
    """
    tokens, owners, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    parts.clear()  # not held beside the whole
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    same = np.zeros(len(ordered), dtype=bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:]
    order = order[same]
    del ordered, same
    tokens, owners, sizes = tokens[order], owners[order], sizes[order]
    order = np.lexsort((owners, tokens))
    tokens, owners, sizes = tokens[order], owners[order], sizes[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    return tokens[new], owners[new], sizes[new]
