"""Embedding near-duplicates: an exact metric range join of unit vectors.

Within one label (and length), cosine >= t is a distance of at most r = sqrt(2 - 2t) between unit
vectors. Pivots, a bounded sample, partition the vectors: each lives in the cell of its nearest pivot p.
A vector within r of a member of cell q lies at most r beyond the hyperplane between p and q
(from the triangle inequality, (d(v,q)^2 - d(v,p)^2) / (2 d(p,q)) <= r), so a vector is
also sent to those cells as a visitor, and each cell then joins on its own: members against members
and visitors. A cell too large for one task is cut again by the distance to its pivot, into ranges of about block_rows
vectors: two ranges join only if they come within r of each other (the triangle inequality once more). A range that holds
more (equal distances) is cut by a salt. Tasks return link counts of members and a spanning forest of
their links, never pairs; equal vectors are one vector with a count from the start.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and those with a
null label, link with nothing (n_links 0, own component); vectors of different lengths never
link. Repeated rows (one id, one vector) are one vector and each get its result; rows of one id and different vectors are
vectors of their own that share the id's component; a null id links with nothing and keeps null results but n_links 0. An
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import components, pieces, stage
from ledgerline.llm.vectors import finite, matrix, pack, unpack

SLACK = 1e-9
RANGES = 64


def near_vectors(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = 2048, block_rows: int = 1024, max_pivots: int = 2048) -> DataFrame:
    """vectors(vec_id, embedding, label) → vec_id, n_links, component_id, kept; one row per input row."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    good = finite(F.col("x")) & F.exists("x", lambda c: c != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    v = v.withColumn("good", good).withColumn("x", F.transform("x", lambda c: c + F.lit(0.0)))  # -0.0 is 0.0
    v = v.select("vec_id", "good", "x", F.when(F.col("good"), F.struct("label", F.xxhash64("x").alias("a"), F.hash("x").alias("b"), F.size("x").alias("dim"))).alias("key"))
    # one row per distinct vector: its smallest id and how many ids have it
    ids = v.where("good").groupBy("key", "vec_id").agg(F.first("x").alias("x"))
    distinct = stage(ids.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x")))
    total = distinct.count()
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    wanted = min(max_pivots, pieces(total, cell_rows))
    sample = distinct.orderBy(F.xxhash64("key"), "rep").limit(wanted).select("key.label", "x").collect()
    pivots: dict[tuple[str, int], list] = {}
    for label, x in sample:
        unit = np.array(x) / np.abs(x).max()
        pivots.setdefault((label, len(x)), []).append(unit / np.linalg.norm(unit))
    pivots = {k: np.array(p) for k, p in pivots.items()}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key")
            names = list(zip(key.field("label").to_pylist(), key.field("dim").to_pylist(), strict=True))
            groups: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                groups.setdefault(name, []).append(i)
            row, cell, home, far, packed = [], [], [], [], np.empty(batch.num_rows, object)
            for name, rows in groups.items():
                for i, b in zip(rows, pack(matrix(batch.column("x").take(pa.array(rows)))), strict=True):
                    packed[i] = b
                p = pivots.get(name)
                if p is None:
                    row += rows
                    cell += [0] * len(rows)
                    home += [True] * len(rows)
                    far += [0.0] * len(rows)
                    continue
                between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
                for a in range(0, len(rows), 1024):
                    some = np.array(rows[a : a + 1024])
                    x = matrix(batch.column("x").take(pa.array(some)))
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    d2 = np.maximum(2 - 2 * x @ p.T, 0)
                    near = np.argmin(d2, axis=1)
                    gap = d2 - d2[np.arange(len(some)), near][:, None]
                    into = gap <= 2 * (radius + SLACK) * between[near] + SLACK
                    into[np.arange(len(some)), near] = True
                    i, q = np.nonzero(into)
                    row += some[i].tolist()
                    cell += q.tolist()
                    home += (near[i] == q).tolist()
                    far += np.sqrt(d2[i, q]).tolist()
            take = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([take.column("rep"), take.column("n"), pa.array(packed[np.array(row, np.int64)], pa.binary()), take.column("key").field("label"), take.column("key").field("dim"), pa.array(cell, pa.int64()), pa.array(home, pa.bool_()), pa.array(far, pa.float64())], names=["rep", "n", "x", "label", "dim", "cell", "home", "d"])

    routed = distinct.repartition(pieces(total, 4096, 4)).mapInArrow(cells, "rep long, n long, x binary, label string, dim int, cell long, home boolean, d double")
    routed = stage(routed.withColumn("cell", F.struct("label", "dim", "cell")).drop("label", "dim"))
    # ranges of the distance to the pivot, RANGES at most and about block_rows vectors each; then salts for ranges that hold more
    cuts = F.percentile_approx("d", [k / RANGES for k in range(1, RANGES)], 2000)
    sizes = routed.groupBy("cell").agg(F.least(F.ceil(F.count("*") / block_rows), F.lit(RANGES)).cast("int").alias("s"), cuts.alias("cuts"))
    edges = F.when(F.col("s") > 1, F.transform(F.sequence(F.lit(1), F.col("s") - 1), lambda k: F.get("cuts", F.floor(k * RANGES / F.col("s")).cast("int") - 1))).otherwise(F.array().cast("array<double>"))
    routed = routed.join(sizes.select("cell", edges.alias("edges")), "cell").withColumn("i", F.size(F.filter("edges", lambda e: e < F.col("d")))).drop("edges")
    full = routed.groupBy("cell", "i").agg(F.ceil(F.count("*") / (2 * block_rows)).cast("int").alias("salts")).where("salts > 1")
    routed = routed.join(full, ["cell", "i"], "left").withColumn("salt", F.pmod(F.xxhash64("rep"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    routed = stage(routed.withColumn("block", F.struct("i", "salt")).drop("i", "salt"))
    blocks = routed.groupBy("cell", "block").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.bool_or("home").alias("members"))
    y = blocks.select("cell", F.col("block").alias("q"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("block.i").alias("i2"))
    spans = blocks.groupBy("cell", F.col("block.i").alias("i2")).agg(F.min("lo").alias("from"), F.max("hi").alias("to")).groupBy("cell").agg(F.collect_list(F.struct("i2", "from", "to")).alias("ranges"))  # at most RANGES of a cell
    x = blocks.where("members").join(spans, "cell")
    x = x.select("cell", F.col("block").alias("p"), "lo", "hi", F.explode(F.filter("ranges", lambda g: (g["from"] <= F.col("hi") + radius + SLACK) & (g["to"] >= F.col("lo") - radius - SLACK))).alias("g")).select("*", F.col("g.i2").alias("i2")).drop("g")
    pairs = stage(x.join(y, ["cell", "i2"]).where((F.col("lo2") <= F.col("hi") + radius + SLACK) & (F.col("hi2") >= F.col("lo") - radius - SLACK)).select("cell", "p", "q"))
    members = routed.where("home").withColumnRenamed("block", "p").join(pairs, ["cell", "p"]).select("cell", "p", "q", "rep", "n", "x", F.lit(True).alias("member"))
    everyone = routed.withColumnRenamed("block", "q").join(pairs, ["cell", "q"]).select("cell", "p", "q", "rep", "n", "x", F.lit(False).alias("member"))

    def join(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy()
        ids, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        x = unpack(table.column("x").to_pylist(), table.column("cell")[0].as_py()["dim"])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        m, e = np.flatnonzero(member), np.flatnonzero(~member)
        every, at = np.unique(ids, return_inverse=True)
        group = np.arange(len(every))  # of each vector: the smallest number of those it is linked with so far
        rep, links, other = [], [], []
        for a in range(0, len(m), 512):
            some = m[a : a + 512]
            close = x[some] @ x[e].T >= threshold
            close &= ids[some][:, None] != ids[e]
            count = close @ n[e]
            hit = np.flatnonzero(count)
            rep += ids[some][hit].tolist()
            links += count[hit].tolist()
            other += [None] * len(hit)
            for u in hit.tolist():
                me, near = at[some[u]], e[close[u]]
                # one link to each group that is not mine yet
                groups, first = np.unique(group[at[near]], return_index=True)
                new = groups != group[me]
                if new.any():
                    rep += [int(ids[some[u]])] * int(new.sum())
                    links += [0] * int(new.sum())
                    other += ids[near[first[new]]].tolist()
                    joined = np.append(groups, group[me])
                    group[np.isin(group, joined)] = joined.min()
        return pa.table({"rep": pa.array(rep, pa.int64()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.int64())})

    found = members.unionByName(everyone).groupBy("cell", "p", "q").applyInArrow(join, "rep long, links long, other long")
    found = stage(found)
    counts = found.groupBy("rep").agg(F.sum("links").alias("near"))
    comp = components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    table = distinct.select("key", "rep", "n").join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    table = table.select("key", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # results come back by (vector, salt), so that a vector that a third of all rows have is no hot key; rows without a key need none
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(pieces(total, 4 * block_rows, 8))).cast("int")
    rows = v.where("good").select("vec_id", "key", salt.alias("salt"))
    table = rows.select("key", "salt").distinct().join(table, "key")
    out = rows.join(table, ["key", "salt"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(v.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
