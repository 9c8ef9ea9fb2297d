"""Sorted arrays of 64-bit keys as short bytes, so that a shuffle moves a few bytes for a key instead of a row.

A chunk of documents sends each bucket one row with all its keys of that bucket. The keys
are hashes and a bucket is a range of them, so buckets are even whatever the texts are, and
a key that occurs in a chunk any number of times is sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def pack(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as their differences, byte by byte of all of them, without bytes that are 0 in all."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    if not width:
        return np.zeros(len(data) - 1, np.uint64)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def by_bucket(keys: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets that ascending keys of ``bits`` bits fall in, and which of the keys do."""
    if not len(keys):
        return
    size = -(-(1 << bits) // buckets)
    of = keys // np.uint64(size)
    edges = np.flatnonzero(np.diff(of, prepend=np.uint64(buckets + 1)))
    for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield int(of[a]), slice(int(a), int(b))


def contains(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are among ``sorted_keys``."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    return sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == keys
