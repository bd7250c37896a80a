"""Substring dedup by relative Lempel-Ziv parsing against all other documents.

The reference is every document with a smaller id, in blocks of a few megabytes. Its index is by
anchors: in each window of `window` words the run of ANCHOR words with the smallest hash. Equal
windows have equal anchors at equal places, so a document needs to be compared with the
reference only at its anchors, a fifth of its words.

1. Every block sends its distinct anchor hashes; those that only one document has end here.
2. A block sends, for anchors found elsewhere too, the hashes of the windows that hang on them, each with the
   smallest document that holds it and its first place there. For each the index of all blocks answers with the leftmost
   source: the smallest document at all, and the place in it.
3. Every document is parsed greedily, left to right: a factor (start, words, document, place) begins at a word whose
   window has a source in an earlier document. It is extended word by word for as long as that document and the place
   in it go on with it, which makes it one passage of that document. At a factor's end the window of
   every following word is looked up as well, so that text across a boundary is found: the next factor may overlap
   the last one. Factors are at least `window` words long; their words are duplicates.

Taking leftmost sources, where a parser of one machine would search the longest, keeps the exchange to one answer a
window; where a smaller document holds part of a passage, the passage is more than one factor, and all of it is covered.
Windows are equal if the 128 bits of their hash and their anchor's are. Texts move to their block's task, by hash of the
id; hashes move as packed arrays, and a window or anchor that many documents of a block share is sent once per block.

Defined results: null and empty texts have no words; texts shorter than the window keep all; texts of any length are
parsed whole; rows of one id are one document's parts, never duplicates of each other (a place counts in the row that holds
it); a null id is larger than any other (such rows are compared as one document). Windows are judged on the input, also
where other windows went. An empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import gram_hashes, mix, pieces, stage, text_buffers, text_chunks, within, word_bounds, word_hashes
from ledgerline.llm.exchange import by_bucket, joined

ANCHOR = 5
NO_ID = np.iinfo(np.int64).max
BLOCK_BYTES = 2 << 20


def _windows(col: pa.Array, window: int, anchor: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word counts before each row, starts of whole windows, their hashes, their anchors' hashes) by chunk."""
    span = window - anchor + 1
    for a, _, data, offs in text_chunks(col):
        starts, ends, first = word_bounds(data, offs)
        h = word_hashes(data, starts, ends)
        at = np.flatnonzero(within(first, window, h.size))
        grams = gram_hashes(h, anchor)
        low = grams[: max(0, h.size - window + 1)].copy()
        for j in range(1, span):
            np.minimum(low, grams[j : j + low.size], out=low)
        # smallest hashes crowd at the low end: mixed again they fill the buckets evenly
        yield a, first, at, gram_hashes(h, window)[at], mix(low[at])


def _ids(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return table.column("doc_id").fill_null(NO_ID).to_numpy()


def find_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs(doc_id, text) → doc_id, text, factors array<struct<start, words, doc_id, place>> (in words; doc_id: the earlier document; place: the passage's start there)."""
    anchor = min(ANCHOR, window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = pieces(size, BLOCK_BYTES, 12)
    buckets = pieces(size, 4 * BLOCK_BYTES, 12)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(blocks)).cast("int")).repartition(pieces(size, 4 * BLOCK_BYTES, 12), "block")
    packed = "bucket int, block int, a binary, b binary, c binary, d binary"

    def send(block: int, h: np.ndarray, *more: np.ndarray) -> pa.Table:
        """A row per bucket with the hashes and what belongs to each."""
        order, some, ends = by_bucket(h, buckets)
        cols = [[x[order[i:j]].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)] for x in (h, *more)]
        cols += [[b""] * len(some)] * (4 - len(cols))
        return pa.table([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", "block", "a", "b", "c", "d"])

    def anchors(table: pa.Table) -> pa.Table:
        ids, found, owner = _ids(table), [], []
        for a, first, at, _, low in _windows(table.column("text").combine_chunks(), window, anchor):
            new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if low.size else np.zeros(0, np.int64)
            found.append(low[new])
            owner.append(ids[a + np.searchsorted(first, at[new], "right") - 1])
        h, d = np.concatenate([*found, np.zeros(0, np.uint64)]), np.concatenate([*owner, np.zeros(0, np.int64)])
        # of each hash the smallest document, and whether the block has another
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.zeros(0, np.int64)
        last = np.concatenate([head[1:], [h.size]]).astype(np.int64) - 1
        return send(table.column("block")[0].as_py(), h[head], d[head], (d[head] != d[last[: head.size]]).astype(np.uint8))

    def shared(table: pa.Table) -> pa.Table:
        (h, n), (d, _), (more, _) = joined(table.column("a"), np.uint64), joined(table.column("b"), np.int64), joined(table.column("c"), np.uint8)
        order = np.lexsort((d, h))
        hs, ds = h[order], d[order]
        head = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if hs.size else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([head, [hs.size]]))
        last = head + size - 1
        many = (ds[head] != ds[last]) | (np.maximum.reduceat(more[order], head) > 0) if head.size else np.zeros(0, bool)
        keep = np.zeros(h.size, bool)
        keep[order] = np.repeat(many, size)
        at = np.concatenate([[0], np.cumsum(n)])
        return pa.table([table.column("block"), pa.array([h[x:y][keep[x:y]].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["block", "a"])

    def distinct_windows(table: pa.Table, hashes: pa.Table) -> tuple[np.ndarray, ...]:
        """Row and word of each window with a shared anchor, its place among the block's distinct ones,
        and of these, sorted: anchor, window, the block's smallest document with it and the first place there."""
        good, ids = np.sort(joined(hashes.column("a"), np.uint64)[0]), _ids(table)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for a, first, at, w, low in _windows(table.column("text").combine_chunks(), window, anchor):
            if good.size and low.size:
                hit = np.flatnonzero(good[np.minimum(np.searchsorted(good, low), good.size - 1)] == low)
                row = np.searchsorted(first, at[hit], "right") - 1
                parts.append((a + row, at[hit] - first[row], low[hit], w[hit]))
        row, word, low, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((word, ids[row], w, low))
        ls, ws = low[order], w[order]
        head = np.concatenate([[True], (ls[1:] != ls[:-1]) | (ws[1:] != ws[:-1])]) if ls.size else np.zeros(0, bool)
        place = np.empty(row.size, np.int64)
        place[order] = np.cumsum(head) - 1
        return row, word, place, ls[head], ws[head], ids[row[order[head]]], word[order[head]].astype(np.int32)

    def ask(table: pa.Table, hashes: pa.Table) -> pa.Table:
        if not table.num_rows or not hashes.num_rows:
            return send(0, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        return send(table.column("block")[0].as_py(), *distinct_windows(table, hashes)[3:])

    def answer(table: pa.Table) -> pa.Table:
        (low, n), (w, _), (d, _), (p, _) = (joined(table.column(c), k) for c, k in zip("abcd", (np.uint64, np.uint64, np.int64, np.int32), strict=True))
        order = np.lexsort((d, w, low))  # a document is in one block: no two entries tie
        ls, ws = low[order], w[order]
        head = np.flatnonzero(np.concatenate([[True], (ls[1:] != ls[:-1]) | (ws[1:] != ws[:-1])])) if ls.size else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([head, [ls.size]]))
        least, where = np.empty(d.size, np.int64), np.empty(d.size, np.int32)
        least[order], where[order] = np.repeat(d[order[head]], times), np.repeat(p[order[head]], times)
        at = np.concatenate([[0], np.cumsum(n)])
        runs = list(zip(at[:-1], at[1:], strict=True))
        return pa.table([table.column("block"), table.column("bucket"), *(pa.array([v[x:y].tobytes() for x, y in runs], pa.binary()) for v in (least, where))], names=["block", "bucket", "least", "place"])

    def parse(table: pa.Table, hashes: pa.Table) -> pa.Table:
        ids = _ids(table)
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(table.num_rows)]
        if hashes.num_rows:
            keyed = hashes.sort_by("bucket")
            row, word, place, *_ = distinct_windows(table, keyed)
            # answers come back in the order of the question: by bucket, and in it by anchor and window
            told = keyed.filter(pa.compute.is_valid(keyed.column("least")))
            ref, spot = joined(told.column("least"), np.int64)[0][place], joined(told.column("place"), np.int32)[0][place]
            hit = ref < ids[row]
            row, word, ref, spot = row[hit], word[hit], ref[hit], spot[hit]
            # a factor goes on while the row is the same, and its next word stands next in the same document
            new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1] + 1) | (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | (spot[1:] != spot[:-1] + 1)])) if row.size else np.zeros(0, np.int64)
            end = np.concatenate([new[1:], [row.size]]).astype(np.int64)[: new.size] - 1
            for o, x, y, r, p in zip(row[new].tolist(), word[new].tolist(), word[end].tolist(), ref[new].tolist(), spot[new].tolist(), strict=True):
                found[o].append((x, y - x + window, r, p))
        factors = pa.array([[{"start": s, "words": n, "doc_id": None if r == NO_ID else r, "place": p} for s, n, r, p in f] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int32())])))
        return pa.table([table.column("doc_id"), table.column("text"), factors], names=["doc_id", "text", "factors"])

    first = placed.groupBy("block").applyInArrow(anchors, packed)
    common = stage(first.groupBy("bucket").applyInArrow(shared, "block int, a binary")).where(F.length("a") > 0)
    asked = placed.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(ask, packed)
    answers = stage(asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, least binary, place binary"))
    back = common.withColumns({"bucket": F.lit(-1), "least": F.lit(None).cast("binary"), "place": F.lit(None).cast("binary")}).unionByName(answers.withColumn("a", F.lit(None).cast("binary")), allowMissingColumns=True)
    back = back.withColumn("a", F.coalesce("a", F.lit(b""))).select("block", "bucket", "a", "least", "place")
    return placed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(parse, "doc_id long, text string, factors array<struct<start:int,words:int,doc_id:long,place:int>>")


def kept_words(docs: DataFrame) -> DataFrame:
    """find_repeats() output with n_words, n_removed and `kept`: the words outside of all factors, joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            lists, flat = batch.column("factors"), batch.column("factors").flatten()
            s, n = flat.field("start").to_numpy(), flat.field("words").to_numpy()
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            words, removed, kept = [], [], []
            for i in range(batch.num_rows):
                text = data[offs[i] : offs[i + 1]]
                starts, ends, _ = word_bounds(text, np.array([0, text.size]))
                keep = np.ones(starts.size, bool)
                for a, k in zip(s[at[i] : at[i + 1]], n[at[i] : at[i + 1]], strict=True):
                    keep[a : a + k] = False
                words.append(starts.size)
                removed.append(int((~keep).sum()))
                raw = text.tobytes()
                kept.append(b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), lists], names=["doc_id", "n_words", "n_removed", "kept", "factors"])

    return docs.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:int,words:int,doc_id:long,place:int>>")
