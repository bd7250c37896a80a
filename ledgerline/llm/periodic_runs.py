"""Periodic runs of words, by an online sparse diagonal dynamic programme.

Two words a lag q apart that are alike lie on diagonal q. Reading a text word by word, the earlier occurrences of what
is read give the lags that match here: each adds one to its lag's match length, lags that do not match
end, and a diagonal that ends long enough is a run, emitted at once. Nothing but the active lags is kept.

A run has at least LEAST words and twice its period, so its diagonal matches on GRAM words in a row at least. The programme
therefore steps over the GRAM-word grams of a text, and only over stretches of those that occurred before: texts that
repeat nothing cost one sort. Three rules, none of which loses a run, keep the active lags few:

* a diagonal within a stretch of n repeated grams has a lag of n + GRAM - 1 at most;
* two runs overlap in fewer words than their periods' sum. So while a run of period p and l words so far goes
  on, lags over p and up to l - p are left alone; where it breaks, lags that match there are followed back to where they began;
* a diagonal is no run of its own where a shorter active lag that divides its lag reaches as far back.

Words are told apart by 64-bit hashes; the runs found are compared word by word, and a text in which that fails is read again with
numbers in place of hashes. Each text is worked on alone: nothing is shuffled, and a task holds one Arrow batch.

Defined results: null and empty texts have no words and no runs; texts of any length are read whole; repeated rows and
rows of one id are each a text of their own; doc_id may be null and of any type; an empty table gives no rows; columns other than doc_id
and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import gram_hashes, text_chunks, word_bounds, word_hashes

#: The least number of words of a run, and the words of a gram: at least LEAST - q and q of a run's words match at lag q.
LEAST = 12
GRAM = LEAST // 2

Run = tuple[int, int, int]


def runs_of_grams(grams: np.ndarray) -> list[Run]:
    """(start, words, period) of all runs in a text whose i-th run of GRAM words is grams[i], by (start, period)."""
    m = len(grams)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    before = np.full(m, -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    hits = np.flatnonzero(before >= 0)
    if not hits.size:
        return []
    cut = np.flatnonzero(np.diff(hits) > 1)
    stretches = list(zip(hits[np.concatenate([[0], cut + 1])].tolist(), (hits[np.append(cut, hits.size - 1)] + 1).tolist(), strict=True))
    g, prev = grams.tolist(), before.tolist()
    found: list[Run] = []

    def ended(q: int, i: int, active: dict[int, int]) -> None:
        """Diagonal q matched for the last time at i - 1."""
        size = active[q] + GRAM - 1 + q
        if size >= max(LEAST, 2 * q) and not any(q % p == 0 and n + p >= active[q] + q for p, n in active.items() if p < q):
            found.append((i + GRAM - 1 - size, size, q))

    for x, y in stretches:
        active: dict[int, int] = {}
        outer: dict[int, dict[int, int]] = {}  # of a run going on, by period: for each gram read, its latest occurrence before the part left alone
        for i in range(x, y):
            now: dict[int, int] = {}
            led, inner = bool(outer), outer
            outer = {}
            j = prev[i]
            while j >= 0 and i - j <= y - x + GRAM - 1:
                q = i - j
                n = active.get(q, 0)
                if n or led or q <= y - i + GRAM - 1:
                    now[q] = 0
                if n and n + GRAM - 1 >= q:
                    # a run of n + GRAM + q words so far: occurrences q to n + GRAM words away are left alone
                    outer[q] = inner.get(q, {})
                    j = outer[q].get(j, j)
                    while j >= max(0, i - n - GRAM):
                        j = prev[j]
                    outer[q][i] = j
                else:
                    j = prev[j]
            for q in now:
                if q in active:
                    now[q] = active[q] + 1
                else:
                    k = i
                    if led:
                        while k > x and k - 1 - q >= 0 and g[k - 1] == g[k - 1 - q]:
                            k -= 1
                    now[q] = i - k + 1
            for q in active:
                if q not in now and g[i] != g[i - q]:
                    ended(q, i, active)
            active = now
        for q in active:
            ended(q, y, active)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number for each run of GRAM words, equal only where the words are."""
    known: dict[tuple[bytes, ...], int] = {}
    return np.array([known.setdefault(tuple(words[i : i + GRAM]), i) for i in range(len(words) - GRAM + 1)], np.int64)


def find_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → doc_id, n_words, runs array<struct<start, length, period>> by (start, period), collapsed: the words that no run repeats, joined by one space."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column("text")):
                starts, ends, first = word_bounds(data, offs)
                grams = gram_hashes(word_hashes(data, starts, ends), GRAM)
                raw, found, left = data.tobytes(), [], []
                for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = grams[lo : max(lo, hi - GRAM + 1)]
                    tidy = np.sort(own)
                    runs = runs_of_grams(own) if (tidy[1:] == tidy[:-1]).any() else []
                    words = [raw[s:e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
                    if any(words[s + q : s + n] != words[s : s + n - q] for s, n, q in runs):
                        runs = runs_of_grams(_numbered(words))
                    if runs:
                        keep = np.ones(hi - lo, bool)
                        for s, n, q in runs:
                            keep[s + q : s + n] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    left.append(b" ".join(words))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(np.diff(first), pa.int64()), pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
