"""Exact nearest rows in Euclidean distance, by boxes of a k-d tree and two rounds of visits.

A sample of the training rows is halved again and again where it is widest; its leaves are boxes, and every training row
goes to one. A query first visits the box that it falls into (and more, where that holds fewer than k rows); its kth
distance there is a bound, and in the second round it visits the boxes whose sides are no farther away. Queries are ordered by their box, so that a
batch visits few boxes. Visits of one batch to one block of a box travel as one packed row; a large box's rows are cut into blocks, so that
the join's tasks are even. No pair is a row.

Only the tree and the boxes' sides (at most BOXES leaves, of SAMPLE rows) pass the driver and are broadcast. A distance is summed from the
differences, so equal rows are 0 apart, also where candidates were found by the faster expanded form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.files import written

BOXES, SAMPLE, BLOCK_ROWS, BATCH = 8192, 65536, 512, 512
#: Numbers that one step compares with boxes.
AT_ONCE = 1 << 22
_NEAR = "id long, near array<struct<distance:double,id:long>>"


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, by the expanded form: good to about 1e-15 of the squared lengths."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def greatest_products(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """vectors(id, x), queries(id, x) → query, id, score, rank: the k greatest inner products of each query, rounded, ties to the smaller id. Exact.

    With one more number, the root of what the longest vector's square has over its own, all vectors are of one length, and the
    greatest product is the least distance. Rounding makes ties, so more than k rows are asked for, and twice as many again for queries
    whose last one still ties with the kth.
    """
    spark = vectors.sparkSession
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    vectors = written(vectors.select("id", F.col("x").alias("own"), square.alias("square")))
    most = vectors.agg(F.max("square")).first()[0]
    if most is None:
        return spark.createDataFrame([], "query long, id long, score double, rank long")
    longer = vectors.select("id", F.concat("own", F.array(F.sqrt(F.greatest(F.lit(most) - F.col("square"), F.lit(0.0))))).alias("x"))
    asked, out, more, n = written(queries.select("id", "x")), None, k + 8, vectors.count()
    while True:
        near = nearest(longer, asked.select("id", F.concat("x", F.array(F.lit(0.0))).alias("x")), more)
        pairs = near.select(F.col("id").alias("query"), F.explode("near.id").alias("id")).join(vectors.select("id", "own"), "id").join(asked.select(F.col("id").alias("query"), "x"), "query")
        dot = F.aggregate(F.zip_with("x", "own", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("long")
        ranked = written(pairs.select("query", "id", F.round(dot, digits).alias("score")).withColumn("rank", rank))
        ends = ranked.groupBy("query").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"), F.min("score").alias("last"), F.count("*").alias("n"))
        tied = ends.where((F.col("n") < n) & (F.col("last") >= F.col("kth"))).select("query")
        done = ranked.where(F.col("rank") <= k).join(tied, "query", "left_anti")
        out = done if out is None else out.unionByName(done)
        asked = written(asked.join(tied.withColumnRenamed("query", "id"), "id"))
        if not asked.count():
            return out.select("query", "id", "score", "rank")
        more *= 2


def grown(x: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """The tree of a sample, node by node: the number compared (-1: a leaf), its bound (below: left), left and right nodes, the leaf's number.

    Leaves hold `leaf` rows at most, unless they are equal.
    """
    nodes, waiting, leaves = [], [np.arange(len(x))], 0
    while len(nodes) < len(waiting):
        own = x[waiting[len(nodes)]]
        wide = int(own.std(0).argmax())
        values = own[:, wide]
        if len(own) <= leaf or values.min() == values.max():
            nodes.append((-1, 0.0, 0, 0, leaves))
            leaves += 1
            continue
        at = np.median(values)
        if not (values < at).any():
            at = values[values > values.min()].min()
        rows = waiting[len(nodes)]
        nodes.append((wide, at, len(waiting), len(waiting) + 1, -1))
        waiting += [rows[values < at], rows[values >= at]]
    return tuple(np.array(c) for c in zip(*nodes, strict=True))


def fallen(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The number of the leaf that each row falls into."""
    wide, at, left, right, leaf = tree
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[wide[node[rows]] >= 0]
        here = node[rows]
        node[rows] = np.where(x[rows, wide[here]] < at[here], left[here], right[here])
    return leaf[node].astype(np.int32)


def nearest(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """train(id long, x array<double>), queries(id long, x), all x of one length without nulls or NaN, ids unique → id,
    near: the k nearest training rows, all if they are fewer, by distance and then id.

    Both may have a number `only`, 0 or more for training rows that are left out for the queries of that number, otherwise -1."""
    spark = train.sparkSession
    numbered = lambda t: t.select("id", "x", (F.col("only").cast("int") if "only" in t.columns else F.lit(-1)).alias("only"))
    train, queries = written(numbered(train)), written(numbered(queries))
    n = train.count()
    if not n:
        return queries.select("id", F.array().cast("array<struct<distance:double,id:long>>").alias("near"))
    width = len(train.first()["x"])

    leaf_rows = min(BOXES, -(-n // BLOCK_ROWS))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = np.concatenate([*(_matrix(batch.column("x"), width) for batch in batches), np.zeros((0, width))])
        tree = grown(sample[np.lexsort(sample.T)], max(1, -(-len(sample) // leaf_rows)))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in tree], names=["wide", "at", "left", "right", "leaf"])

    # a part of the rows by a hash: no row is preferred; one task holds its about SAMPLE rows, the driver only gets the tree
    share = train if n <= SAMPLE else train.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (SAMPLE << 30) // n)
    nodes = share.select("x").repartition(1).mapInArrow(grow, "wide long, at double, left long, right long, leaf long").toArrow()
    known = spark.sparkContext.broadcast(tuple(nodes.column(c).to_numpy() for c in nodes.column_names))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = fallen(known.value, _matrix(batch.column("x"), width))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), batch.column("only"), pa.array(box)], names=["id", "x", "only", "box"])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        x = _matrix(table.column("x").combine_chunks(), width)
        binary = lambda v: pa.array([v.tobytes()], pa.binary())
        return pa.table({"box": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "rows": pa.array([len(x)], pa.int64()), "low": binary(x.min(0)), "high": binary(x.max(0)), "own": binary(table.column("id").to_numpy()), "own_only": binary(table.column("only").to_numpy()), "own_xs": binary(x)})

    # the rows of a box, in blocks of about BLOCK_ROWS; finding a row's box twice is less than storing all rows once more
    held = train.mapInArrow(assign, "id long, x array<double>, only int, box int")
    sizes = held.groupBy("box").agg(F.count("*").alias("rows"))  # a row for each leaf
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int")
    cut = held.join(F.broadcast(sizes), "box").select("box", block.alias("block"), "id", "only", "x")
    blocks = written(cut.groupBy("box", "block").applyInArrow(pack, "box int, block int, rows long, low binary, high binary, own binary, own_only binary, own_xs binary"))

    def sides(key: tuple, table: pa.Table) -> pa.Table:
        low, high = (np.array([np.frombuffer(v.as_py()) for v in table.column(c)]) for c in ("low", "high"))
        binary = lambda v: pa.array([v.tobytes()], pa.binary())
        return pa.table({"box": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([pa.compute.sum(table.column("rows")).as_py()], pa.int64()), "low": binary(low.min(0)), "high": binary(high.max(0)), "parts": binary(np.sort(table.column("block").to_numpy()))})

    # the sides of each leaf's rows, and which blocks it has: a row for each leaf, however many blocks there are
    told = blocks.select("box", "block", "rows", "low", "high").groupBy("box").applyInArrow(sides, "box int, rows long, low binary, high binary, parts binary").collect()
    leaves = max(r["box"] for r in told) + 1
    low, high, rows, parts = np.full((leaves, width), np.inf), np.full((leaves, width), -np.inf), np.zeros(leaves, np.int64), [[] for _ in range(leaves)]
    for r in told:
        b = r["box"]
        low[b], high[b], rows[b], parts[b] = np.frombuffer(r["low"]), np.frombuffer(r["high"]), r["rows"], np.frombuffer(r["parts"], np.int32).tolist()
    del told
    facts = spark.sparkContext.broadcast((low, high, rows, parts))

    def home(b: int) -> np.ndarray:
        """The boxes that queries of box b visit first: it, and those around its middle until they hold k rows."""
        low, high, rows, _ = facts.value
        if rows[b] >= k:
            return np.array([b])
        middle = (low[b] + high[b]) / 2
        order = np.argsort((np.maximum(0, np.maximum(low - middle, middle - high)) ** 2).sum(1) + (np.arange(len(low)) != b), kind="stable")
        return order[: np.searchsorted(np.cumsum(rows[order]), k) + 1]

    def visits(first: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, _, parts = facts.value
            for whole in batches:
                out = []
                for batch in (whole.slice(a, BATCH) for a in range(0, whole.num_rows, BATCH)):
                    x, ids, only, at = _matrix(batch.column("x"), width), *(batch.column(c).to_numpy() for c in ("id", "only", "box"))
                    bound = np.full(len(x), np.inf) if first else batch.column("bound").to_numpy(zero_copy_only=False)
                    go = {}
                    for b in np.unique(at):
                        own, seen = np.flatnonzero(at == b), home(b)
                        if first:
                            for v in seen:
                                go.setdefault(int(v), []).append(own)
                            continue
                        slack = 1e-7 * (1 + np.abs(x[own]).max(1, initial=0) * width)
                        reach = (bound[own] + slack) ** 2
                        apart = (np.maximum(0, np.maximum(low - x[own].max(0), x[own].min(0) - high)) ** 2).sum(1)
                        some = np.setdiff1d(np.flatnonzero(apart <= reach.max()), seen)
                        step = max(1, AT_ONCE // (max(1, len(some)) * width))
                        for a in range(0, len(own), step):
                            v = x[own[a : a + step], None, :]
                            near = (np.maximum(0, np.maximum(low[some] - v, v - high[some])) ** 2).sum(2) <= reach[a : a + step, None]
                            for j in np.flatnonzero(near.any(0)):
                                go.setdefault(int(some[j]), []).append(own[a : a + step][near[:, j]])
                    for v, lists in go.items():
                        o = np.concatenate(lists)
                        out += [(v, p, ids[o].tobytes(), only[o].tobytes(), x[o].tobytes(), bound[o].tobytes()) for p in parts[v]]
                for a in range(0, len(out), 64):
                    columns = zip(*out[a : a + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["box", "block", "ids", "onlys", "xs", "bounds"])

        return choose

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ids, q, bound = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["xs"]).reshape(-1, width), np.frombuffer(row["bounds"])
                other, x = np.frombuffer(row["own"], np.int64), np.frombuffer(row["own_xs"]).reshape(-1, width)
                rough, few = _apart(q, x), min(k, len(x)) - 1
                own_only, only = np.frombuffer(row["own_only"], np.int32), np.frombuffer(row["onlys"], np.int32)
                if own_only.max() >= 0:
                    rough[(only[:, None] == own_only) & (own_only >= 0)] = np.inf
                most = np.minimum(np.partition(rough, few, axis=1)[:, few], bound**2)
                slack = 1e-13 * width * ((q * q).sum(1) + (x * x).sum(1).max()) + 1e-300
                of, at = np.nonzero((rough <= (most + slack)[:, None]) & np.isfinite(rough))
                away = np.concatenate([np.sqrt(((x[at[a : a + 65536]] - q[of[a : a + 65536]]) ** 2).sum(1)) for a in range(0, len(of), 65536)] or [np.zeros(0)])
                order = np.lexsort((other[at], away, of))
                of, at, away = of[order], at[order], away[order]
                counts = np.bincount(of, minlength=len(q))
                kept = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) < k
                counts = np.minimum(counts, k)
                has = np.flatnonzero(counts)
                near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[has])]), pa.int32()), pa.StructArray.from_arrays([pa.array(away[kept]), pa.array(other[at[kept]])], names=["distance", "id"]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), near], names=["id", "near"])

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        near = asked.repartitionByRange("box", "id").sortWithinPartitions("box")
        packed = near.mapInArrow(visits(first), "box int, block int, ids binary, onlys binary, xs binary, bounds binary")
        # packed numbers make small files of large rows: never broadcast
        return packed.join(blocks.hint("merge"), ["box", "block"]).select("ids", "onlys", "xs", "bounds", "own", "own_only", "own_xs").mapInArrow(meet, _NEAR)

    merged = lambda t: t.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # noqa: E731  a list for each block that a query has visited
    asked = written(queries.mapInArrow(assign, "id long, x array<double>, only int, box int"))
    found = written(merged(searched(asked, True)))
    bound = F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).otherwise(float("inf"))
    again = searched(asked.join(found.select("id", bound.alias("bound")).hint("merge"), "id"), False)
    return merged(found.unionByName(again))
