"""Byte-level dedup of repeated passages through run-length indexes of what may repeat.

A window is `window` consecutive bytes of one document. Its anchor is the leftmost of its GRAM-byte grams with the least hash;
equal windows have equal anchors at equal places. Consecutive windows with one anchor make a region, so each window
lies in one region, and only regions with equal anchors can share a window.

1. Every block of documents sends its regions as pairs of hashes, anchor and content; pairs that are alike travel once, with a mark.
   Anchors that one place has end here. Regions found in two places repeat as a whole.
2. Of each anchor with different contents, one block sends each content's bytes. A bucket of anchors builds the
   run-compressed Burrows-Wheeler transform of its regions, takes the matches at its runs' ends, and marks the windows
   that repeat (run_length_index).
3. An anchor with more than HOT contents, such as the edge of a passage that a large share of all documents holds, would outgrow its bucket.
   Its contents' windows are counted by hash instead, alike ones of a block as one, in buckets of their own.
4. Every block covers its repeated windows' bytes, and what is left is kept.

What a task holds is a block or a bucket, both of a fixed size in expectation; the number of either follows the input. Regions and
windows of anchors are compared by 128 bits of hashes (content and anchor), windows in an index byte by byte.

Defined results: null and empty texts have no bytes; texts shorter than the window keep all; texts of any length are read whole, in
stretches of CHUNK bytes; repeated rows, and several rows of one id, are documents that repeat each other; a null id is an id as any other.
An empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import _BASE, CHUNK_BYTES, _power_tables, mix, pieces, stage, text_buffers
from ledgerline.llm.exchange import by_bucket, joined
from ledgerline.llm.run_length_index import END, repeated_windows

GRAM = 16
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 2 << 20
HOT = 1024
REPEATED, MIXED, SENDER, MANY = 1, 2, 4, 8
_SENT = "kind int, bucket int, block int, a binary, b binary, c binary, d binary"


class Regions(NamedTuple):
    first: np.ndarray  # first byte of the first window
    last: np.ndarray  # first byte of the last window
    anchor: np.ndarray
    content: np.ndarray
    place: np.ndarray  # the anchor's byte


def _anchors(data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the bytes its anchor's place, and all grams' hashes."""
    words = np.ndarray((data.size - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    h = mix(words[: data.size - GRAM + 1] * np.uint64(_BASE) ^ mix(words[GRAM - 8 :]))
    wide = window - GRAM + 1
    low = np.uint64((1 << int(wide).bit_length()) - 1)
    whole = -(-h.size // wide) * wide
    keys = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    keys[: h.size] = h & ~low
    keys = keys.reshape(-1, wide) | np.arange(wide, dtype=np.uint64)  # ties go to the left
    ahead = np.minimum.accumulate(keys, axis=1).ravel()
    behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(data.size - window + 1)
    left, right = behind[at], ahead[at + wide - 1]
    from_left = (left & ~low) <= (right & ~low)
    block = np.where(from_left, at // wide, (at + wide - 1) // wide)
    return block * wide + np.where(from_left, left & low, right & low).astype(np.int64), h


def _regions(data: np.ndarray, offs: np.ndarray, window: int) -> Regions:
    """The regions of a block's documents, left to right; places are bytes of the block."""
    found = [Regions(*(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64, np.int64)))]
    for x in range(int(offs[0]), int(offs[-1]) - window + 1, CHUNK_BYTES):
        part = data[x : min(x + CHUNK_BYTES + window - 1, int(offs[-1]))]
        place, grams = _anchors(part, window)
        row_end = offs[np.searchsorted(offs, x + np.arange(place.size), "right")] - x
        good = np.flatnonzero(np.arange(place.size) + window <= row_end)
        if not good.size:
            continue
        own = place[good]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (good[1:] != good[:-1] + 1)]))
        first, last, own = good[new], good[np.append(new[1:], good.size) - 1], own[new]
        up, down = _power_tables(part.size + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: part.size])])
        said = mix((sums[last + window] - sums[first]) * down[first])
        shape = (own - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
        found.append(Regions(first + x, last + x, mix(grams[own]), mix(said ^ mix(shape)), own + x))
    return Regions(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _heads(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(keys[0].size, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _once(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tuples of keys: one place of each different one, whether it has more, and the number of each place's own."""
    order, number = np.lexsort(keys), np.empty(keys[0].size, np.int64)
    head = _heads(*(k[order] for k in keys))
    many = np.diff(np.append(head, order.size))
    number[order] = np.repeat(np.arange(head.size), many)
    return order[head], many > 1, number


def _sorted(table: pa.Table) -> pa.Table:
    """A block's rows in an order of their own: they come in any, and stretches are cut through the block's bytes."""
    return table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _text(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(table.column("text").combine_chunks())


def find_byte_repeats(docs: DataFrame, window: int = 400, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) → doc_id, n_bytes, spans array<struct<start, end>> of removed bytes, kept binary: the other bytes. window: GRAM bytes at least."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks, parts = pieces(size, BLOCK_BYTES, 12), pieces(size, 4 * BLOCK_BYTES, 12)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(parts, "block")

    def send(kind: int, block: int, h: np.ndarray, buckets: int, *more: np.ndarray | list[bytes]) -> list[tuple]:
        """A row for each bucket, with the hashes and what belongs to each, in the order of the hashes."""
        order, some, ends = by_bucket(h, buckets)
        pack = lambda v, own: b"".join(v[i] for i in own) if isinstance(v, list) else v[own].tobytes()
        return [(kind, int(b), block, *(pack(v, order[i:j]) for v in (h, *more)), *(b"",) * (3 - len(more))) for b, i, j in zip(some, ends[:-1], ends[1:], strict=True)]

    def sent(made: list[tuple]) -> pa.Table:
        kinds = (pa.int32(),) * 3 + (pa.binary(),) * 4
        return pa.table([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=["kind", "bucket", "block", *"abcd"])

    def first_round(table: pa.Table) -> pa.Table:
        r = _regions(*_text(_sorted(table)), window)
        at, more, _ = _once(r.content, r.anchor)
        return sent(send(0, table.column("block")[0].as_py(), r.anchor[at], parts, r.content[at], more.astype(np.uint8)))

    def meet(table: pa.Table) -> pa.Table:
        """For each pair of hashes that matters: its flags."""
        (a, n), (c, _), (more, _) = joined(table.column("a"), np.uint64), joined(table.column("b"), np.uint64), joined(table.column("c"), np.uint8)
        order, flags = np.lexsort((c, a)), np.zeros(a.size, np.uint8)
        if a.size:
            sa, sc = a[order], c[order]
            anchor, content = _heads(sa), _heads(sa, sc)
            held = np.add.reduceat(more[order].astype(np.int64) + 1, content)
            kinds = np.diff(np.append(np.searchsorted(content, anchor), content.size))
            own = np.searchsorted(anchor, content, "right") - 1
            flag = REPEATED * (held > 1) | MIXED * (kinds[own] > 1) | MANY * (kinds[own] > hot)
            flags[order] = np.repeat(flag, np.diff(np.append(content, a.size)))
            flags[order[content[kinds[own] > 1]]] |= SENDER
        ends = np.concatenate([[0], np.cumsum(n)])
        keep = [np.flatnonzero(flags[x:y]) + x for x, y in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([table.column("block"), *(pa.array([v[k].tobytes() for k in keep], pa.binary()) for v in (a, c, flags))], names=["block", "a", "b", "c"])

    def flagged(table: pa.Table, told: pa.Table) -> tuple[np.ndarray, Regions, np.ndarray]:
        """The block's bytes, its regions, and their flags."""
        data, offs = _text(table)
        r = _regions(data, offs, window)
        flags = np.zeros(r.first.size, np.uint8)
        a, c, f = (joined(told.column(x), k)[0] for x, k in zip("abc", (np.uint64, np.uint64, np.uint8), strict=True))
        if c.size and flags.size:
            order = np.argsort(c, kind="stable")
            at = order[np.minimum(np.searchsorted(c[order], r.content), c.size - 1)]
            flags = np.where((c[at] == r.content) & (a[at] == r.anchor), f[at], 0).astype(np.uint8)
        return data, r, flags

    def windows_of(data: np.ndarray, r: Regions, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of these regions: region, first byte, hash."""
        many = r.last[own] - r.first[own] + 1
        which = np.repeat(own, many)
        start = np.arange(which.size) - np.repeat(np.cumsum(many) - many, many) + r.first[which]
        out = np.zeros(start.size, np.uint64)
        up, down = _power_tables(BLOCK_BYTES)
        for k in np.unique(start // CHUNK_BYTES):  # prefix sums of a stretch at a time
            here = np.flatnonzero(start // CHUNK_BYTES == k)
            part = data[k * CHUNK_BYTES : (k + 1) * CHUNK_BYTES + window]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: part.size])])
            s = start[here] - k * CHUNK_BYTES
            out[here] = mix((sums[s + window] - sums[s]) * down[s])
        return which, start, out

    def asks(r: Regions, flags: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The regions that a block sends in the second round, and of those of hot anchors the windows: first byte, number, and each number's hash, key and whether it is there twice."""
        sender = np.flatnonzero(flags & SENDER)
        sender = sender[np.unique(r.content[sender], return_index=True)[1]]  # by content: a block's rows may come in any order
        which, start, h = windows_of(data, r, sender[flags[sender] & MANY > 0])
        key = mix(r.anchor[which] + (r.place[which] - start).astype(np.uint64))
        at, more, number = _once(h, key)
        return sender[flags[sender] & MANY == 0], (start, number, mix(h[at]), key[at], more.astype(np.uint8))

    def second_round(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return sent([])
        block, (data, r, flags) = table.column("block")[0].as_py(), flagged(_sorted(table), told)
        own, (_, _, h, key, more) = asks(r, flags, data)
        texts = [data[x : y + window].tobytes() for x, y in zip(r.first[own].tolist(), r.last[own].tolist(), strict=True)]
        return sent(send(1, block, mix(r.anchor[own]), index_buckets, (r.last[own] - r.first[own] + window).astype(np.int32), texts) + send(2, block, h, parts, key, more))

    def answer(table: pa.Table) -> pa.Table:
        a, n = joined(table.column("a"), np.uint64)
        if table.column("kind")[0].as_py() == 1:
            lengths, _ = joined(table.column("b"), np.int32)
            raw, _ = joined(table.column("c"), np.uint8)
            ends = np.cumsum(lengths)
            text = np.full(raw.size + lengths.size, END, np.uint8)
            at = np.arange(raw.size) + np.repeat(np.arange(lengths.size), lengths)
            text[at] = raw
            marks = repeated_windows(text, window)[at]
            # a region's windows begin at all of its bytes but the last window - 1
            windows = np.arange(raw.size) + window <= np.repeat(ends, lengths)
            bits, count = marks[windows], lengths - window + 1
        else:
            b, _ = joined(table.column("b"), np.uint64)
            more, _ = joined(table.column("c"), np.uint8)
            order, bits = np.lexsort((b, a)), np.zeros(a.size, bool)
            head = _heads(a[order], b[order]) if a.size else order
            bits[order] = np.repeat(np.add.reduceat(more[order].astype(np.int64) + 1, head) > 1 if a.size else bits, np.diff(np.append(head, a.size)))
            count = np.ones(a.size, np.int64)
        row = np.concatenate([[0], np.cumsum(n)])
        cut = np.concatenate([[0], np.cumsum(count)])[row]
        return pa.table([table.column("block"), table.column("kind"), table.column("bucket"), pa.array([np.packbits(bits[x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["block", "kind", "bucket", "bits"])

    def cover(table: pa.Table, back: pa.Table) -> pa.Table:
        table = _sorted(table)
        data, offs = _text(table)
        marks = np.zeros(data.size + 1, np.int64)
        if back.num_rows and table.num_rows:
            data, r, flags = flagged(table, back.filter(pa.compute.equal(back.column("kind"), 0)))
            whole = flags & REPEATED > 0
            own, (start, number, h, *_) = asks(r, flags, data)
            bits = {(k, b): np.unpackbits(np.frombuffer(v, np.uint8)) > 0 for k, b, v in zip(*(back.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True) if k}

            def told(kind: int, keys: np.ndarray, buckets: int, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """The answers, `each` of them a question, and the questions in that order."""
                order, some, ends = by_bucket(keys, buckets)
                return np.concatenate([np.zeros(0, bool), *(bits[kind, b][: each[order[i:j]].sum()] for b, i, j in zip(some.tolist(), ends[:-1], ends[1:], strict=True))]), order

            many = r.last[own] - r.first[own] + 1
            yes, order = told(1, mix(r.anchor[own]), index_buckets, many)
            many = many[order]
            indexed = (np.repeat(r.first[own][order] - (np.cumsum(many) - many), many) + np.arange(yes.size))[yes]
            yes, order = told(2, h, parts, np.ones(h.size, np.int64))
            again = np.zeros(h.size, bool)
            again[order] = yes
            counted = start[again[number]]
            for first, last in ((r.first[whole], r.last[whole]), (indexed, indexed), (counted, counted)):
                np.add.at(marks, first, 1)
                np.add.at(marks, last + window, -1)
        gone = np.cumsum(marks[:-1]) > 0
        spans, kept, n_bytes = [], [], []
        for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            own = np.concatenate([[False], gone[x:y], [False]])
            edge = np.flatnonzero(own[1:] != own[:-1])
            spans.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            kept.append(data[x:y][~gone[x:y]].tobytes() if edge.size else data[x:y].tobytes())
            n_bytes.append(y - x)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([table.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    begun = placed.groupBy("block").applyInArrow(first_round, _SENT)
    met = stage(begun.groupBy("bucket").applyInArrow(meet, "block int, a binary, b binary, c binary")).where(F.length("c") > 0)
    own = met.select(F.sum(F.length("c"))).first()[0]
    index_buckets = pieces((own or 0) * 2 * window, BUCKET_BYTES, 12)
    asked = placed.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(second_round, _SENT)
    answers = stage(asked.groupBy("kind", "bucket").applyInArrow(answer, "block int, kind int, bucket int, bits binary"))
    back = met.select("block", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("bits"), "a", "b", "c").unionByName(answers, allowMissingColumns=True)
    full = back.withColumns({c: F.coalesce(c, F.lit(b"")) for c in "abc"})
    return placed.groupBy("block").cogroup(full.groupBy("block")).applyInArrow(cover, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
