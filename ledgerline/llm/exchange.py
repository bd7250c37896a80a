"""Exchange of packed hashes: arrays travel as binary values, one row per (bucket, sender).

Hash joins of hundreds of millions of small numbers cost less as a few large rows than as rows of
their own: a task sorts its numbers by bucket and sends one row to each. Buckets are hash
ranges of about equal size, so their number, set from the input, bounds what one task gathers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts by (bucket, hash), the buckets that have a hash, and the places between which each has its own.

    A bucket is a range of the hash, floor(h * buckets / 2^64). The work depends on the hashes, not on the number of buckets.
    """
    order = np.argsort(h, kind="stable")
    n, half = np.uint64(buckets), np.uint64(32)
    bucket = ((h >> half) * n + ((h & np.uint64(0xFFFFFFFF)) * n >> half) >> half)[order]
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if h.size else np.zeros(0, np.int64)
    return order, bucket[head].astype(np.int64), np.append(head, h.size).astype(np.int64)


def unpack(value: pa.Scalar | bytes, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer() if isinstance(value, pa.Scalar) else value, kind)


def joined(col: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column in a row, and how many each row has."""
    parts = [unpack(x, kind) for x in col]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([p.size for p in parts], np.int64)
