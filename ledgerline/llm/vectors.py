"""Vectors as numpy arrays: checks on columns, and array columns as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(embedding: Column) -> Column:
    """The vector is not null and holds no null and no non-finite component."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, odd)


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long lists, without nulls, as a double matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    n = len(col)
    values = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: four a component where that is exact, else eight."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    exact = (short == x).all(axis=1)
    return [(a if e else b).tobytes() for a, b, e in zip(short, x, exact, strict=True)]


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """The rows of pack(), as doubles."""
    if not rows:
        return np.zeros((0, dim))
    kinds = {len(r) for r in rows}
    if len(kinds) == 1:
        return np.frombuffer(b"".join(rows), np.float32 if kinds == {4 * dim} else np.float64).reshape(len(rows), dim).astype(float)
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in rows], float)
