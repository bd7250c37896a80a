"""Packing token pieces into sequences: length patterns fitted by non-negative least squares, residuals by best fit.

Texts are tokenized once; longer ones are cut into full pieces (the first may be shorter). All
decisions are taken on the histogram of piece lengths, at most `size` numbers whatever the corpus:

1. lengths are rounded up to classes; patterns of at most three classes that fill a sequence are enumerated;
2. non-negative least squares finds how often to repeat each pattern to match the histogram;
3. repeats are rounded down and turned into runs of exact lengths; a pattern's shortest place
   takes the longest piece that still fits, so that what classes rounded up is not lost;
4. best fit, longest first, puts the residual pieces into what those sequences have left, and into new ones.

Best fit also works on counts: sequences of the same content are one entry with a
multiplicity. The plan is again a table of runs: (length, ranks from, ranks to) → (sequences, offset).
A piece finds its place by its rank among the pieces of its length; ranks are counted in two
levels (salted buckets, then within), so one length may be shared by any number of pieces.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an
empty table gives no rows. Text order and other columns have no influence on the plan.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import pieces as parts
from ledgerline.llm.common import stage

#: The byte-level tokenizer's pre-tokenizer pattern, in a form that needs no backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoder(ranks: str, special: tuple[tuple[str, int], ...]):
    """A function from texts to arrays of ids: byte-level BPE with the merge ranks of a file.

    The ids are those of the `tokenizers` file of the same vocabulary (tests compare them),
    at five times its speed. A special token's string in a text is that token.
    """
    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    made = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens=dict(special))
    return lambda text: made.encode_to_numpy(text, allowed_special="all")


def tokenize_pieces(docs: DataFrame, ranks: str, special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),), size: int = 2048, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) → doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks, special), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                some = batch.slice(a, 128)
                owner, piece, start, ids = [], [], [], []
                for i, text in enumerate(some.column("text").to_pylist()):
                    got = (encode(text).astype("<u4").tobytes() if text else b"") + end
                    n = len(got) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        owner.append(i)
                        piece.append(k)
                        start.append(x)
                        ids.append(got[4 * x : 4 * y])
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


# ---------------------------------------------------------------- the plan, on counts

def nnls(a: np.ndarray, b: np.ndarray, steps: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: an active set of columns, each step adding the one with the steepest descent."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(steps):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-7 * (1 + np.abs(b).max()):
            break
        used[j] = True
        while True:
            ids = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, ids], b, rcond=None)[0]
            if (s > 1e-12).all():
                x[:] = 0
                x[ids] = s
                break
            low = s <= 1e-12
            step = np.min(x[ids][low] / np.maximum(x[ids][low] - s[low], 1e-300))
            x[ids] += step * (s - x[ids])
            used[ids[x[ids] <= 1e-12]] = False
            x[~used] = 0
    return x


def length_patterns(classes: int) -> list[tuple[int, ...]]:
    """All multisets of one to three classes 1..classes that sum to `classes`."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(a, classes - a) for a in range((classes + 1) // 2, classes)]
    out += [(a, b, classes - a - b) for a in range(1, classes) for b in range(1, a + 1) if 0 < classes - a - b <= b]
    return out


def pack_plan(histogram: dict[int, int], size: int, classes: int = 128, keep: tuple[float, ...] = (1.0, 0.8, 0.5, 0.25)) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, pieces per sequence, offset) that place every piece.

    A run places `count` pieces of one length, from a rank on, into count / per sequence
    consecutive sequences, `per` of them side by side from the offset. The fitted repeats are
    rounded down at several shares, as more residuals let best fit mend more; the plan with
    the fewest sequences is taken.
    """
    patterns, repeats, width = fit_patterns(histogram, size, classes)
    plans = (_realise(histogram, size, width, patterns, share * repeats) for share in keep)
    return min(plans, key=lambda p: p[1])[0]


def fit_patterns(histogram: dict[int, int], size: int, classes: int) -> tuple[list[tuple[int, ...]], np.ndarray, int]:
    """Patterns of length classes, how often to repeat each, and the width of a class."""
    width = -(-size // classes)
    full = size // width
    target = np.zeros(full + 1)
    for n, c in histogram.items():
        if -(-n // width) <= full:
            target[-(-n // width)] += c
    patterns = length_patterns(full)
    if not target.sum():
        return patterns, np.zeros(len(patterns)), width
    a = np.zeros((full + 1, len(patterns)))
    for j, p in enumerate(patterns):
        for k in p:
            a[k, j] += 1
    # small classes are easily placed later: an error there costs less
    trust = np.sqrt(np.arange(full + 1) / full)
    return patterns, nnls(a * trust[:, None], target / target.max() * trust) * target.max(), width


def _realise(histogram: dict[int, int], size: int, width: int, patterns: list[tuple[int, ...]], repeats: np.ndarray) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan of the repeats rounded down and best fit for the rest, and its number of sequences."""
    left = {n: c for n, c in histogram.items() if c > 0}
    made: list[tuple[list[tuple[int, int]], int]] = []  # (runs of (length, times), sequences of this content)
    if left:
        stock = sorted(left)  # lengths with pieces left
        for j in np.argsort([-max(p) for p in patterns], kind="stable"):
            need, pattern = int(np.floor(repeats[j] + 1e-6)), patterns[j]
            while need > 0:
                space, times = size, defaultdict(int)
                for place, k in enumerate(pattern):
                    last = place == len(pattern) - 1 and place > 0
                    top, least = (space, 1) if last else (min(space, k * width), (k - 1) * width + 1)
                    i = bisect.bisect_right(stock, top) - 1
                    while i >= 0 and left[stock[i]] <= times[stock[i]]:
                        i -= 1
                    if i < 0 or stock[i] < least:
                        break
                    times[stock[i]] += 1
                    space -= stock[i]
                else:
                    m = min(need, *(left[n] // t for n, t in times.items()))
                    for n, t in times.items():
                        left[n] -= m * t
                        if not left[n]:
                            stock.remove(n)
                    made.append((list(times.items()), m))
                    need -= m
                    continue
                break
    # best fit, longest first: free[s] holds entries of `made` with s tokens left
    free: dict[int, list[int]] = defaultdict(list)
    for i, (content, _) in enumerate(made):
        free[size - sum(n * t for n, t in content)].append(i)
    spaces = sorted(s for s in free if s)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(spaces, n)
            if at == len(spaces):
                per = size // n
                m, rest = divmod(left[n], per)
                for count, sequences in ((per, m), (rest, 1 if rest else 0)):
                    if sequences:
                        made.append(([(n, count)], sequences))
                        s = size - n * count
                        if s and s not in free or s and not free[s]:
                            bisect.insort(spaces, s)
                        free[s].append(len(made) - 1)
                left[n] = 0
                break
            s = spaces[at]
            i = free[s].pop()
            if not free[s]:
                spaces.pop(at)
            content, sequences = made[i]
            per = min(s // n, left[n])
            m = min(sequences, left[n] // per)
            left[n] -= m * per
            if m < sequences:
                made.append((content, sequences - m))
                if not free[s]:
                    bisect.insort(spaces, s)
                free[s].append(len(made) - 1)
            made[i] = ([*content, (n, per)], m)
            s -= n * per
            if s:
                if not free[s]:
                    bisect.insort(spaces, s)
                free[s].append(i)
    ranks: dict[int, int] = defaultdict(int)
    plan, sequence = [], 0
    for content, sequences in made:
        offset = 0
        for n, per in content:
            plan.append((n, ranks[n], per * sequences, sequence, per, offset))
            ranks[n] += per * sequences
            offset += n * per
        sequence += sequences
    return plan, sequence


def place_pieces(pieces: DataFrame, size: int = 2048, bucket_rows: int = 50_000) -> DataFrame:
    """pieces(length, …) with sequence_id and offset. Reads its input twice; give it a staged table."""
    histogram = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most `size` rows
    plan = sorted(pack_plan(histogram, size))
    base, at = {}, 0
    for n in sorted(histogram):
        base[n] = at
        at += histogram[n]
    lengths = np.array(sorted(histogram), np.int64)
    bases = np.array([base[n] for n in lengths], np.int64)
    runs = np.array(plan, np.int64).reshape(-1, 6)
    begin = np.array([base[r[0]] + r[1] for r in plan], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(begin, bases[np.searchsorted(lengths, n)] + rank, "right") - 1
            nth = rank - runs[run, 1]
            seq = runs[run, 3] + nth // runs[run, 4]
            offset = runs[run, 5] + nth % runs[run, 4] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(seq), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "rank", "bucket", "before")]
    buckets = parts(sum(histogram.values()), bucket_rows)
    salted = pieces.select(*kept).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    counts = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    counts = counts.select("length", "bucket", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start"))
    ranked = salted.withColumn("inner", inner).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inner") - 1)
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, ranks: str, size: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, [ids,] ids_crc32, sequence_id, offset; one row per piece."""
    made = tokenize_pieces(docs, ranks, size=size, end_id=end_id).withColumn("ids_crc32", F.crc32("ids"))
    return place_pieces(stage(made if keep_ids else made.drop("ids")), size)
