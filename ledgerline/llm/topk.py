"""Exact top-k by inner product with KD-trees per shard.

Components are quantized to floor(256 x), so scores are integers. Median splits of a bounded sample give every
vector a cell; ranges of (length, cell, place along the cell's widest side) of about `shard_rows` vectors are the
shards, so that cells of any size, and any number of equal vectors, make shards of one size.

Each shard's task builds a KD-tree: median splits on the widest side down to small leaves, each node
with its tight bounding box and smallest id. For a query q, no vector of a box scores
more than sum(max(q lo, q hi)); nodes are visited best bound first until the bound is below
the kth score (or equals it and no smaller id is left). The kth score is propagated: every query first searches
its own shard, in the task that built the tree; its kth score there goes with it to those other shards whose box
can still reach it. The query set is a stated share of the rows. Queries travel as packed blocks, one for each shard
that some query of the block reaches; what no bound admits is never written. A shard that many queries reach is
searched by several tasks of about `query_rows` queries. (Where bounds prune nothing, as in many random dimensions,
the work is that of all queries against all rows, in blocks.)

Bounds and scores are doubles while those are exact (below 2^53). Beyond it bounds are widened by the rounding error
and every score in question is counted again in integers of any size.

Defined results: vectors that are null, empty or hold null or non-finite components (or components whose 256-fold
is not finite) take no part; vectors of another length than the query's are not compared with it; a score beyond a long
ranks by its true value and is shown as the nearest long; rows of one id and one vector count once, rows of one
id never answer that id's query; with fewer than k candidates all are returned; repeated vectors of different ids are
ranked by id; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import pieces, stage
from ledgerline.llm.vectors import finite, matrix, pack, unpack

LONG = (-(1 << 63), (1 << 63) - 1)
PART = 4096  # shard boxes that travel together
PACK = 4096  # vectors of one packed row


class KDTree:
    """Median splits with tight boxes over the rows of x; ids break ties."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = 128) -> None:
        self.x, self.ids = x, ids
        self.nodes: list[tuple[np.ndarray, int, int]] = []  # rows of a leaf (else empty), left, right
        lo, hi, least = [], [], []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                node = list(self.nodes[parent])
                node[1 + side] = me
                self.nodes[parent] = tuple(node)
            part = x[rows]
            lo.append(part.min(axis=0))
            hi.append(part.max(axis=0))
            least.append(ids[rows].min())
            wide = hi[-1] - lo[-1]
            if len(rows) <= leaf or not wide.any():
                self.nodes.append((rows[np.argsort(ids[rows], kind="stable")], -1, -1))
                continue
            axis, half = int(np.argmax(wide)), len(rows) // 2
            order = rows[np.argpartition(part[:, axis], half)]
            self.nodes.append((rows[:0], -1, -1))
            todo += [(order[:half], me, 0), (order[half:], me, 1)]
        self.lo, self.hi, self.least = np.array(lo), np.array(hi), np.array(least)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query (score, -id) of its k best rows, best first; floor: at most a score that k rows elsewhere reach."""
        bound = upper_bounds(q, self.lo, self.hi)
        slack = rounding(q, np.maximum(np.abs(self.lo[0]), np.abs(self.hi[0])))
        out = []
        for i in range(len(q)):
            best: list[tuple[int, int]] = []  # a heap, the worst of k on top
            # Python's numbers compare integers of any size with doubles exactly
            up, err, least = bound[i].tolist(), float(slack[i]), float(floor[i])
            heap = [(-up[0], 0)]
            whole = None if err == 0 else [int(a) for a in q[i].tolist()]
            while heap:
                b, node = heapq.heappop(heap)
                kth = max(least, best[0][0]) if len(best) == k else least
                if err - b < kth:
                    break
                if len(best) == k and err == 0 and -b == best[0][0] and self.least[node] > -best[0][1]:
                    continue
                rows, left, right = self.nodes[node]
                if left >= 0:
                    for child in (left, right):
                        if up[child] + err >= kth:
                            heapq.heappush(heap, (-up[child], child))
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    score = self.x[rows] @ q[i]
                    near = np.flatnonzero(~(score + err < below(kth)))
                for j in near:
                    if self.ids[rows[j]] != own[i]:
                        exact = int(score[j]) if whole is None else sum(int(a) * c for a, c in zip(self.x[rows[j]].tolist(), whole, strict=True))
                        item = (exact, -int(self.ids[rows[j]]))
                        if exact < least:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
            out.append(sorted(best, reverse=True))
        return out


def below(n: float) -> float:
    """A double that is at most n, n itself up to 2^53."""
    try:
        x = float(n)
    except OverflowError:
        return float(np.finfo(float).max) if n > 0 else -np.inf
    return x if x <= n else float(np.nextafter(x, -np.inf))


def upper_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each query and box the most that a vector of the box can score."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    return np.where(np.isfinite(bound), bound, np.inf)


def rounding(q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each query what rounding can change in a score of vectors of at most this size; 0 where doubles are exact."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.abs(q) @ most
    return np.where(size < 2.0**53, 0.0, np.where(np.isfinite(size), size * (q.shape[1] + 2) * 2.0**-51, np.inf))


def _splits(sample: np.ndarray, depth: int) -> tuple[list[tuple[int, float]], list[int]]:
    """Median splits of the sample as a complete binary tree in heap order: (axis, value), right where x > value; the widest side of each cell."""
    wide = lambda c: int(np.argmax(c.max(axis=0) - c.min(axis=0))) if len(c) else 0
    cells, out = [sample], []
    for _ in range(depth):
        below = []
        for c in cells:
            axis = wide(c)
            value = float(np.median(c[:, axis])) if len(c) else 0.0
            out.append((axis, value))
            right = c[:, axis] > value if len(c) else np.zeros(0, bool)
            below += [c[~right], c[right]]
        cells = below
    return out, [wide(c) for c in cells]


def _answers(own: np.ndarray, found: list[list[tuple[int, int]]]) -> pa.Table:
    rows = [(int(o), -i, s) for o, best in zip(own, found, strict=True) for s, i in best]
    over = [f"{s + (1 << 2200):0552x}" if s <= LONG[0] or s >= LONG[1] else "" for _, _, s in rows]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([min(max(r[2], LONG[0]), LONG[1]) for r in rows], pa.int64()), pa.array(over, pa.string())], names=["query_id", "vec_id", "score", "over"])


def top_k(vectors: DataFrame, queries: Column, k: int = 5, shard_rows: int = 65_536, least_shards: int = 24, sample_rows: int = 8192, query_rows: int = 65_536) -> DataFrame:
    """vectors(vec_id, embedding) → query_id, rank, vec_id, score for the rows where `queries` holds.

    least_shards: as many shards are made of a small table, so that a cluster has work for all.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = finite(F.col("embedding")) & (F.size("embedding") > 0) & F.col("vec_id").isNotNull() & ~F.exists(x, lambda c: F.abs(c * 256) == float("inf"))
    v = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"), F.size("embedding").alias("dim"))
    total = v.count()
    shards = pieces(total, shard_rows, least_shards)
    cells: dict[int, tuple] = {}
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("dim", "x").toArrow()
    dims = sample.column("dim").to_numpy() if sample.num_rows else np.zeros(0, int)
    for dim in np.unique(dims).tolist():
        rows = matrix(sample.column("x").take(pa.array(np.flatnonzero(dims == dim))))
        depth = min(np.log2(max(1, shards * len(rows) / len(dims))), np.log2(max(1, len(rows) / 8)))
        cells[dim] = _splits(np.floor(256 * rows), int(np.ceil(depth)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, n = batch.column("dim").to_numpy(), batch.num_rows
            cell, along, packed = np.zeros(n, np.int64), np.zeros(n), [b""] * n
            for d in np.unique(dim).tolist():
                rows = np.flatnonzero(dim == d)
                x, node = np.floor(256 * matrix(batch.column("x").take(pa.array(rows)))) + 0.0, np.zeros(len(rows), np.int64)
                splits, sides = cells.get(d, ([], [0]))
                axis = np.array([a for a, _ in splits] + [0])
                value = np.array([b for _, b in splits] + [0.0])
                while (inner := node < len(splits)).any():
                    go = node[inner]
                    node[inner] = 2 * go + 1 + (x[np.flatnonzero(inner), axis[go]] > value[go])
                cell[rows] = node - len(splits)
                along[rows] = x[np.arange(len(rows)), np.array(sides)[cell[rows]]]
                for i, p in zip(rows.tolist(), pack(x), strict=True):
                    packed[i] = p
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("asks"), batch.column("dim"), pa.array(cell), pa.array(along), pa.array(packed, pa.binary())], names=["vec_id", "asks", "dim", "cell", "along", "x"])

    placed = v.mapInArrow(route, "vec_id long, asks boolean, dim int, cell long, along double, x binary")
    placed = placed.repartitionByRange(shards, "dim", "cell", "along", F.xxhash64("vec_id"), "vec_id").select("vec_id", "asks", "dim", "x")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each length in the shard: its vectors, packed; its box; its queries with what they found here."""
        table, me = pa.Table.from_batches(list(batches), _PLACED), TaskContext.get().partitionId()
        for d in np.unique(table.column("dim").to_numpy()).tolist():
            rows = table.filter(pa.compute.equal(table.column("dim"), d))
            # rows of one id and one vector are one
            asks: dict[tuple[int, bytes], bool] = {}
            for i, b, a in zip(*(rows.column(c).to_pylist() for c in ("vec_id", "x", "asks")), strict=True):
                asks[i, b] = asks.get((i, b), False) or a
            ids, packed, ask = np.array([i for i, _ in asks], np.int64), [b for _, b in asks], np.array(list(asks.values()))
            x = unpack(packed, d)
            tree = KDTree(x, ids)
            for a in range(0, len(ids), PACK):
                yield _row(0, d, me, ids[a : a + PACK], packed[a : a + PACK])
            box = np.stack([tree.lo[0], tree.hi[0]])
            yield _row(1, d, me, ids[:0], [box.tobytes()])
            for a in range(0, len(ids), PACK):
                some = a + np.flatnonzero(ask[a : a + PACK])
                if some.size:
                    found = tree.search(x[some], ids[some], k, np.full(some.size, -np.inf))
                    floor = np.array([below(f[-1][0]) if len(f) == k else -np.inf for f in found])
                    yield _row(2, d, me, ids[some], [packed[i] for i in some], floor, _answers(ids[some], found))

    made = stage(placed.mapInArrow(build, f"kind int, dim int, shard long, n int, ids binary, x array<binary>, floor binary, found array<struct<{_FOUND}>>"))
    # the boxes: packed by parts, and the parts once for every group of query blocks
    boxes = made.where("kind = 1").select("dim", "shard", F.element_at("x", 1).alias("box")).withColumn("part", F.floor(F.col("shard") / PART))
    groups, parts = pieces(shards, 256), pieces(shards, PART)
    boxes = boxes.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asks = made.where("kind = 2").select("dim", "shard", "ids", "x", "floor").withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def reach(asks_: pa.Table, boxes_: pa.Table) -> pa.Table:
        """For each block of queries and each other shard that some of them can reach: those queries."""
        out = []
        if asks_.num_rows and boxes_.num_rows:
            d = asks_.column("dim")[0].as_py()
            both = np.stack([np.frombuffer(b, float).reshape(2, d) for b in boxes_.column("box").to_pylist()])
            shard = boxes_.column("shard").to_numpy()
            most = np.abs(both).max(axis=(0, 1))
            for home, ids, packed, floor in zip(*(asks_.column(c).to_pylist() for c in ("shard", "ids", "x", "floor")), strict=True):
                ids, floor, x = np.frombuffer(ids, np.int64), np.frombuffer(floor, float), unpack(packed, d)
                can = upper_bounds(x, both[:, 0], both[:, 1]) + rounding(x, most)[:, None] >= floor[:, None]
                can[:, shard == home] = False
                for j in np.flatnonzero(can.any(axis=0)).tolist():
                    some = np.flatnonzero(can[:, j])
                    out.append((d, int(shard[j]), home, some.size, ids[some].tobytes(), [packed[i] for i in some], floor[some].tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.binary())
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["dim", "shard", "home", "n", "ids", "x", "floor"])

    keys = ["dim", "part", "group"]
    visits = stage(asks.groupBy(*keys).cogroup(boxes.groupBy(*keys)).applyInArrow(reach, "dim int, shard long, home long, n int, ids binary, x array<binary>, floor binary"))
    chunks = visits.groupBy("dim", "shard").agg(F.ceil(F.sum("n") / query_rows).alias("chunks"))
    visits = visits.join(chunks, ["dim", "shard"]).withColumn("chunk", F.pmod(F.xxhash64("home"), F.col("chunks"))).drop("chunks", "home", "n")
    rows = made.where("kind = 0").select("dim", "shard", "ids", "x").join(chunks, ["dim", "shard"])
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")

    def search(asks_: pa.Table, rows_: pa.Table) -> pa.Table:
        if not asks_.num_rows or not rows_.num_rows:
            return _answers(np.zeros(0), [])
        d = asks_.column("dim")[0].as_py()
        whole = lambda t, c, kind: np.concatenate([np.frombuffer(b, kind) for b in t.column(c).to_pylist()])
        vectors_ = lambda t: unpack([b for r in t.column("x").to_pylist() for b in r], d)
        tree = KDTree(vectors_(rows_), whole(rows_, "ids", np.int64))
        q, own, floor, found = vectors_(asks_), whole(asks_, "ids", np.int64), whole(asks_, "floor", float), []
        for a in range(0, len(own), 512):
            found += tree.search(q[a : a + 512], own[a : a + 512], k, floor[a : a + 512])
        return _answers(own, found)

    keys = ["dim", "shard", "chunk"]
    far = visits.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(search, _FOUND.replace(":", " "))
    near = made.where("kind = 2").select(F.explode("found").alias("f")).select("f.*")
    # of each query at most k rows of its own shard and k of every shard that its bound admits
    best = F.struct("score", "over", "vec_id")
    ranked = near.union(far).distinct().groupBy("query_id").agg(F.collect_list(best).alias("all"))
    order = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["over"] != b["over"], F.when(a["over"] > b["over"], -1).otherwise(1)).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
    ranked = ranked.select("query_id", F.posexplode(F.slice(F.array_sort("all", order), 1, k)).alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


_FOUND = "query_id:long,vec_id:long,score:long,over:string"
_PLACED = pa.schema([("vec_id", pa.int64()), ("asks", pa.bool_()), ("dim", pa.int32()), ("x", pa.binary())])
_ANSWER = pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("over", pa.string())])


def _row(kind: int, dim: int, shard: int, ids: np.ndarray, x: list[bytes], floor: np.ndarray | None = None, found: pa.Table | None = None) -> pa.RecordBatch:
    cols = [pa.array([kind], pa.int32()), pa.array([dim], pa.int32()), pa.array([shard], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x], pa.list_(pa.binary())), pa.array([None if floor is None else floor.tobytes()], pa.binary()), pa.array([None if found is None else found.to_pylist()], pa.list_(_ANSWER))]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "dim", "shard", "n", "ids", "x", "floor", "found"])
