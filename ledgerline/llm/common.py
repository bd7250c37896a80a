"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than space and U+0009..U+000D. Those
separators are single bytes in UTF-8, so words can be found on the raw Arrow text
buffers, a chunk of documents at a time, without making a Python object per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset a session of one machine (tests, the bench) gets a new folder; on a cluster,
    where executors would each write to a disk of their own, it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="spark-stage-")
        sc.setCheckpointDir(_own_dirs[sc.applicationId])
    return _own_dirs[sc.applicationId]


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, with underscores added until no column has it."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` units the total makes."""
    return max(least, -(-int(total or 0) // each))


def lower_ascii(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- text buffers

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not pa.types.is_string(col.type) and not pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with about `limit` bytes."""
    data, offs = text_buffers(col)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_bounds(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row (and the end) the number of words before it. gaps: for each byte, whether it parts words."""
    n = data.size
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~gaps[data]
    edge = np.empty(n + 1, bool)  # True: a word cannot run on from i - 1 to i
    edge[0] = edge[n] = True
    edge[1:n] = ~word[:-1]
    edge[offs] = True
    starts = np.flatnonzero(word & edge[:n])
    edge[1:n] = ~word[1:]
    edge[offs] = True
    ends = np.flatnonzero(word & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


# ---------------------------------------------------------------- hashing

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial over the whole chunk."""
    if not starts.size:
        return np.zeros(0, _U)
    up, down = _power_tables(data.size + 1)
    sums = np.zeros(data.size + 1, _U)
    np.cumsum(((_LOWER[data] if lower else data).astype(_U) + _U(1)) * up[: data.size], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive entries (across rows too; the caller keeps those within a row)."""
    m = max(0, h.size - n + 1)
    out = h[:m].copy()
    for j in range(1, n):
        out *= _U(0xD6E8FEB86659FD93)
        out += h[j : j + m]
    return mix(out)


def within(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each start of a run of n words in the chunk: whether the run lies within one row."""
    m = max(0, total - n + 1)
    row_end = np.repeat(first[1:], np.diff(first))[:m]
    return np.arange(m) + n <= row_end


def doc_shingles(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles of n lower-cased words); shorter texts make one shingle."""
    for a, b, data, offs in text_chunks(col):
        starts, ends, first = word_bounds(data, offs)
        h = word_hashes(data, starts, ends, lower=True)
        grams = gram_hashes(h, n)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                yield a + i, np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield a + i, mix(gram_hashes(h[lo:hi], int(hi - lo)) + _U(hi - lo))
            else:
                yield a + i, h[:0]


# ---------------------------------------------------------------- links

class Forest:
    """Union-find over 0..n-1; a root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(u long, v long): (node, component = smallest node), one row per linked node.

    Alternating large-star and small-star steps: each node hands the smallest node it knows
    to its neighbours, until all edges point straight at their component's smallest node. A
    step is two aggregations and joins; its edges, never more than before, are staged, and
    only their number and checksum reach the driver. Null ends and self links are ignored.
    """
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    u, v = F.col("u"), F.col("v")
    edges = stage(links.where(u != v).select(pair(u.cast("long"), v.cast("long")).alias("e")).select("e.*").distinct())
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        large = both.where(v > u).join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(F.greatest(v, F.col("m")).alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where(u != v).distinct()
        edges = stage(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(u.alias("node"), v.alias("component")).union(edges.select(v, v).distinct())
        seen = now
