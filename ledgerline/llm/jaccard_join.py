"""N-gram Jaccard self-join by signature trees.

A document's set is its distinct shingles of n words. Two documents link when
100 * |A ∩ B| >= percent * |A ∪ B|. The join finds all links' components:

1. Filter. A linked document shares all but at most d = n - ceil(t n) of its n shingles with one
   other. Blocks send the shingles of a fixed hash range (RANGE of all) as short fingerprints; a document
   that has more than d of them to itself links with nothing. Few documents remain.
2. Cells. Hash ranges cut the shingles of a set of its size class into more parts than two linked sets can
   differ in, so linked sets agree in some part. Parts with few shingles are left out as long as enough others must
   agree. Documents with an equal part are in one cell (components of a star per part).
3. Signature trees. Each cell's distinct sets, with size ranges and OR-combined bitmaps in hierarchical
   nodes, are joined by dual traversal: a pair of nodes is dropped when the overlap that their bitmaps and
   sizes allow is too small, or when all below is one component already. What is
   left is counted exactly on the shingles. Cells too large for one task are grids of blocks by size and
   salt; pairs of blocks whose sizes cannot link are never made. Tasks return spanning forests.

Equal sets are one set with its smallest id throughout. Nothing is capped.

Defined results: A-Z are lower-cased; texts shorter than n words make one shingle of all their
words; null texts and texts without words have an empty set and link with nothing; texts of any length are read whole; rows of
one id (repeated rows too) are one node (linked if any of them is) and each get a result; rows with a null id keep a null
component; an empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Forest, components, doc_shingles, mix, pieces, stage
from ledgerline.llm.exchange import by_bucket, joined, unpack

RANGE = 0.4
BLOCK_BYTES = 4 << 20
BLOCK_SHINGLES = 1 << 20  # shingles of one block of a large cell: 8 MB
LEAF = 16


class Sizes:
    """Size classes of sets for a threshold: linked sets are in the same or in neighbouring classes."""

    def __init__(self, percent: int, largest: int = 1 << 48) -> None:
        """largest: more shingles than any text that fits into a row has."""
        self.percent = percent
        low = [1]
        while low[-1] <= largest:  # sets that must be equal are in one class, whatever its width
            low.append(low[-1] * 100 // percent + 1 if percent < 100 else 2 * low[-1])
        self.low = np.array(low)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def differ(self, c: int) -> int:
        """The most shingles in which linked sets can differ if the smaller is of class c."""
        return int((self.low[c + 1] - 1) * (100 - self.percent) // self.percent)

    def spare(self, n: int) -> int:
        """The most shingles of a set of n that a linked set can lack."""
        return n + (-n * self.percent) // 100


def set_parts(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Hashes of the parts of a sorted set, one of which each linked set shares."""
    out, n, c = [], s.size, sizes.of(s.size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    for scheme in (c, c - 1):
        if scheme < 0:
            continue
        tag = mix(np.array([scheme + 1], np.uint64))
        k = sizes.differ(scheme)
        if k == 0:
            out.append(mix(sums[-1:] ^ tag))
            continue
        if k == 1:  # the set itself, and it without any one shingle
            out.append(mix(np.concatenate([sums[-1:], sums[-1] - np.diff(sums)]) ^ tag))
            continue
        weak = max(1, (k + 1) // 5)
        p = k + 1 + weak
        edges = ((np.arange(1, p, dtype=object) << 64) // p).astype(np.uint64) if p < 64 else (np.arange(1, p, dtype=np.float64) / p * 2.0**64).astype(np.uint64)
        cut = np.concatenate([[0], np.searchsorted(s, edges), [n]])
        size = np.diff(cut)
        part = mix((sums[cut[1:]] - sums[cut[:-1]]) ^ mix(np.arange(p, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tag))
        strong = size >= 2
        out.append(part[strong] if p - int(strong.sum()) <= weak else part)
    return np.concatenate(out)


class SignatureTree:
    """Nodes over sorted sets: OR-combined bitmaps, size range, most shingles lost to equal bits, and the sets below."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, bits: int) -> None:
        self.order = order
        self.maps = np.zeros((len(order), bits // 64), np.uint64)
        for i, j in enumerate(order):
            b = (sets[j] & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(self.maps[i], b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
        self.size = np.array([sets[j].size for j in order])
        self.lost = self.size - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)
        # levels of nodes, from leaves of LEAF sets up to one root: (maps, least size, most, most lost, first set, end)
        self.levels = []
        at = np.arange(0, len(order), LEAF)
        level = (np.bitwise_or.reduceat(self.maps, at, axis=0), np.minimum.reduceat(self.size, at), np.maximum.reduceat(self.size, at), np.maximum.reduceat(self.lost, at), at, np.append(at[1:], len(order)))
        self.levels.append(level)
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), 4)
            level = (np.bitwise_or.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at), level[4][at], level[5][np.append(at[1:], len(level[5])) - 1])
            self.levels.append(level)


def tree_join(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int, forest: Forest) -> list[tuple[int, int]]:
    """A spanning forest of the links among `left`, or between left and right (numbers of sets)."""
    most = max((s.size for s in sets), default=1)
    bits = 1 << min(20, max(9, int(4 * most - 1).bit_length()))
    key = lambda ids: ids[np.lexsort(([int(sets[i][0]) if sets[i].size else 0 for i in ids], [sets[i].size // 8 for i in ids]))]
    a = SignatureTree(sets, key(left), bits)
    b = a if right is None else SignatureTree(sets, key(right), bits)
    links: list[tuple[int, int]] = []
    need = lambda x, y: -(-(x + y) * percent // (100 + percent))  # the overlap that sets of x and y shingles need
    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        i, x, j, y = todo.pop()
        ma, lo_a, hi_a, lost_a, from_a, to_a = (v[x] for v in a.levels[i])
        mb, lo_b, hi_b, lost_b, from_b, to_b = (v[y] for v in b.levels[j])
        if a is b and from_a > from_b and i == j:
            continue
        if hi_a * 100 < lo_b * percent or hi_b * 100 < lo_a * percent:
            continue
        bound = min(int(np.bitwise_count(ma & mb).sum()) + min(lost_a, lost_b), hi_a, hi_b)
        if bound < need(lo_a, lo_b):
            continue
        if i or j:
            if i >= j:  # open the higher node
                todo += [(i - 1, c, j, y) for c in range(4 * x, min(4 * x + 4, len(a.levels[i - 1][1])))]
            else:
                todo += [(i, x, j - 1, c) for c in range(4 * y, min(4 * y + 4, len(b.levels[j - 1][1])))]
            continue
        ra, rb = np.arange(from_a, to_a), np.arange(from_b, to_b)
        roots_a, roots_b = [forest.find(int(a.order[r])) for r in ra], [forest.find(int(b.order[r])) for r in rb]
        if len({*roots_a, *roots_b}) == 1:
            continue
        common = np.bitwise_count(a.maps[ra][:, None, :] & b.maps[rb][None, :, :]).sum(axis=2).astype(np.int64)
        common += np.minimum(a.lost[ra][:, None], b.lost[rb][None, :])
        sa, sb = a.size[ra][:, None], b.size[rb][None, :]
        can = (np.minimum(common, np.minimum(sa, sb)) >= need(sa, sb)) & (np.array(roots_a)[:, None] != np.array(roots_b)[None, :])
        for u, v in zip(*np.nonzero(can), strict=True):
            p, q = int(a.order[ra[u]]), int(b.order[rb[v]])
            if p == q or forest.find(p) == forest.find(q):
                continue
            s, t = sets[p], sets[q]
            same = int(np.isin(s, t, assume_unique=True).sum())
            if same * 100 >= percent * (s.size + t.size - same):
                forest.join(p, q)
                links.append((p, q))
    return links


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) → doc_id, n_shingles, component_id; one row per input row."""
    sizes = Sizes(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks, buckets, tasks = pieces(total, BLOCK_BYTES, 12), pieces(total, 4 * BLOCK_BYTES, 12), pieces(total, 4 * BLOCK_BYTES, 12)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(blocks)).cast("int")).repartition(tasks, "block")
    top = np.uint64(int(RANGE * (1 << 64)))

    def own_range(s: np.ndarray) -> np.ndarray:
        return s[: np.searchsorted(s, top)]

    def spread(h: np.ndarray) -> np.ndarray:
        """The fixed hash range stretched over all 64 bits; sorted stays sorted."""
        return np.minimum(h / RANGE, 2.0**64 - 4096).astype(np.uint64)

    def fingerprints(table: pa.Table) -> pa.Table:
        found = [own_range(s) for _, s in doc_shingles(table.column("text").combine_chunks(), shingle)]
        h = np.concatenate([*found, np.zeros(0, np.uint64)])
        h, n = np.unique(h, return_counts=True)
        # the bucket is a range of the hash; 32 bits below it and whether the block has it twice travel
        _, some, ends = by_bucket(spread(h), buckets)
        runs = list(zip(ends[:-1], ends[1:], strict=True))
        short = (mix(h) >> np.uint64(32)).astype(np.uint32)
        return pa.table([pa.array(some, pa.int32()), pa.array([table.column("block")[0].as_py()] * len(some), pa.int32()), pa.array([short[x:y].tobytes() for x, y in runs], pa.binary()), pa.array([np.packbits(n[x:y] > 1).tobytes() for x, y in runs], pa.binary())], names=["bucket", "block", "a", "b"])

    def shared(table: pa.Table) -> pa.Table:
        h, n = joined(table.column("a"), np.uint32)
        twice = np.concatenate([np.unpackbits(unpack(b, np.uint8), count=int(k)) for b, k in zip(table.column("b"), n, strict=True)]).astype(bool)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        many = np.bincount(back, twice, count.size) + (count > 1)
        bits, at = many[back] > 0, np.concatenate([[0], np.cumsum(n)])
        return pa.table([table.column("block"), table.column("bucket"), pa.array([np.packbits(bits[x:y]).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["block", "bucket", "a"])

    def sets(table: pa.Table, flags: pa.Table) -> pa.Table:
        """Size and hash of each document's set; the set itself where the filter leaves it."""
        found = [s for _, s in doc_shingles(table.column("text").combine_chunks(), shingle)]
        h = np.unique(np.concatenate([*(own_range(s) for s in found), np.zeros(0, np.uint64)]))
        _, some, ends = by_bucket(spread(h), buckets)
        known = np.zeros(h.size, bool)
        for bucket, bits in zip(flags.column("bucket").to_pylist(), flags.column("a"), strict=True):
            at = np.searchsorted(some, bucket)
            x, y = ends[at], ends[at + 1]
            known[x:y] = np.unpackbits(unpack(bits, np.uint8), count=int(y - x))
        kept, one, two = [], [], []
        for s in found:
            own = own_range(s)
            alone = own.size - int(known[np.searchsorted(h, own)].sum())
            kept.append(s.tobytes() if s.size and alone <= sizes.spare(s.size) else None)
            one.append(int(mix(s).sum(dtype=np.uint64)))
            two.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5555))) if s.size else 0))
        return pa.table([table.column("doc_id"), pa.array([s.size for s in found], pa.int64()), pa.array(one, pa.uint64()).view(pa.int64()), pa.array(two, pa.uint64()).view(pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n", "one", "two", "s"])

    sent = placed.groupBy("block").applyInArrow(fingerprints, "bucket int, block int, a binary, b binary")
    flags = sent.groupBy("bucket").applyInArrow(shared, "block int, bucket int, a binary")
    read = stage(placed.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(sets, "doc_id long, n long, one long, two long, s binary"))

    # distinct sets; a set's node is its smallest id
    same = ["n", "one", "two"]
    left = read.where("s is not null and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("s").alias("s"))
    left = stage(left)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a batch, sets that share a part are starred at once; one of them goes on."""
        for batch in batches:
            node = batch.column("node").to_numpy()
            each = [set_parts(unpack(s, np.uint64), sizes) for s in batch.column("s")]
            h = np.concatenate([*each, np.zeros(0, np.uint64)])
            d = np.repeat(node, [x.size for x in each])
            u, v, h, d = _stars(h, d)
            _, some, ends = by_bucket(h, buckets)
            runs = list(zip(ends[:-1], ends[1:], strict=True))
            cols = [[*some, -1], [h[x:y].tobytes() for x, y in runs] + [u.tobytes()], [d[x:y].tobytes() for x, y in runs] + [v.tobytes()]]
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "a", "b"])

    def stars(table: pa.Table) -> pa.Table:
        u, v, _, _ = _stars(joined(table.column("a"), np.uint64)[0], joined(table.column("b"), np.int64)[0])
        return pa.table({"u": u, "v": v})

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, v in zip(batch.column("a"), batch.column("b"), strict=True):
                yield pa.record_batch({"u": pa.array(unpack(u, np.int64)), "v": pa.array(unpack(v, np.int64))})

    sent = stage(left.repartition(tasks).mapInArrow(parts, "bucket int, a binary, b binary"))
    near = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(stars, "u long, v long").union(sent.where("bucket < 0").select("a", "b").mapInArrow(edges, "u long, v long"))
    cell = components(near)

    # blocks of large cells: by size (steps of a twentieth) and salt; small cells are one block
    member = left.select("node", "n").join(cell, "node").select("node", "n", F.col("component").alias("cell"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05))).cast("int")
    whole = member.groupBy("cell").agg((F.sum("n") > BLOCK_SHINGLES).alias("large"))
    member = member.join(whole, "cell").withColumn("step", F.when(F.col("large"), step).otherwise(0))
    full = member.where("large").groupBy("cell", "step").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("salts"))
    member = member.join(full, ["cell", "step"], "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).cast("int"))
    member = stage(member.select("node", "n", "cell", "large", "step", "salt"))
    block = member.where("large").groupBy("cell", "step", "salt").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    y = block.alias("y")
    reach = int(ceil(np.log(100 / percent) / np.log(1.05))) + 1
    x = block.select("cell", "step", "salt", "lo", "hi", F.explode(F.sequence(F.col("step"), F.col("step") + reach)).alias("step2")).alias("x")
    pair = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.step2") == F.col("y.step"))).where((F.col("y.step") > F.col("x.step")) | (F.col("y.salt") >= F.col("x.salt"))).where((F.col("x.hi") * 100 >= F.col("y.lo") * percent) & (F.col("y.hi") * 100 >= F.col("x.lo") * percent))
    pair = pair.select(F.col("x.cell").alias("cell"), F.struct("x.step", "x.salt").alias("p"), F.struct("y.step", "y.salt").alias("q"))
    goes = pair.select("cell", "p", "q", F.explode(F.array_distinct(F.array(F.struct(F.col("p").alias("b"), F.lit(0).alias("side")), F.struct(F.col("q").alias("b"), F.when(F.col("p") == F.col("q"), 0).otherwise(1).alias("side"))))).alias("g"))
    goes = goes.select("cell", "p", "q", F.col("g.b.step").alias("step"), F.col("g.b.salt").alias("salt"), F.col("g.side").alias("side"))
    alone = F.struct(F.lit(0).alias("step"), F.lit(0).alias("salt"))
    small = member.where("not large").select("node", "cell", alone.alias("p"), alone.alias("q"), F.lit(0).alias("side"))
    big = member.where("large").join(goes, ["cell", "step", "salt"]).select("node", "cell", "p", "q", "side")
    asks = small.union(big).join(left.select("node", "s"), "node")
    groups = pieces(member.count(), 512, 12)
    task = F.when(F.col("p") == F.col("q"), F.pmod(F.xxhash64("cell", "p"), F.lit(groups))).otherwise(F.pmod(F.xxhash64("cell", "p", "q"), F.lit(1 << 40)) + groups)

    def join(table: pa.Table) -> pa.Table:
        cells: dict[tuple, list[int]] = {}
        for i, r in enumerate(table.select(["cell", "p", "q"]).to_pylist()):
            cells.setdefault((r["cell"], *r["p"].values(), *r["q"].values()), []).append(i)
        node, side, s = table.column("node").to_numpy(), table.column("side").to_numpy(), table.column("s")
        u, v = [], []
        for at in cells.values():
            sets_ = [unpack(s[i], np.uint64) for i in at]
            sides = side[at]
            left_, right_ = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
            if len(left_) and (len(right_) or not sides.any()):
                for p, q in tree_join(sets_, left_, right_ if len(right_) else None, percent, Forest(len(at))):
                    u.append(int(node[at[p]]))
                    v.append(int(node[at[q]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    linked = asks.withColumn("task", task).groupBy("task").applyInArrow(join, "u long, v long")
    # equal sets: every id with a set points at the set's node
    copies = read.where("n > 0 and doc_id is not null").select("doc_id", *same)
    nodes = copies.groupBy(*same).agg(F.min("doc_id").alias("v"))
    equal = copies.join(nodes, same).where("doc_id != v").select(F.col("doc_id").alias("u"), "v")
    comp = components(linked.union(equal))
    out = read.select("doc_id", "n").join(comp, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _stars(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges from each d to the smallest d with the same h, and the distinct h, sorted, with their smallest d."""
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    head = np.concatenate([[True], h[1:] != h[:-1]]) if h.size else np.zeros(0, bool)
    low = d[head][np.cumsum(head) - 1] if h.size else d
    far = d != low
    edge = np.unique(np.stack([d[far], low[far]]), axis=1)
    return edge[0], edge[1], h[head], d[head]
