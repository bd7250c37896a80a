"""Run-length indexes and byte-level dedup against counts of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm.byte_dedup import find_byte_repeats
from ledgerline.llm.run_length_index import BEYOND, END, common_prefix, repeated_windows, suffix_ranks

WINDOW = 40


def collections(n, window, seed):
    """Strings that take parts of each other, repeat themselves, or have few different bytes."""
    rnd = random.Random(seed)
    for _ in range(n):
        docs, few = [], rnd.choice([1, 2, 3, 90])
        for _ in range(rnd.randint(1, 8)):
            d = b""
            for _ in range(rnd.randint(0, 4)):
                if docs and rnd.random() < 0.5:
                    s = rnd.choice(docs)
                    a = rnd.randint(0, len(s))
                    d += s[a : a + rnd.randint(0, 3 * window)]
                else:
                    d += bytes(32 + rnd.randrange(few) for _ in range(rnd.randint(0, 2 * window)))
            docs.append(d)
        yield docs


def marked(docs, window):
    """For each text, its bytes in windows that start at two places."""
    times = Counter(d[i : i + window] for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if times[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append(bytes(gone))
    return out


def test_index_of_any_collection():
    for docs in collections(300, 15, 1):
        window = 1 + len(docs) * 2
        raw = b"".join(d + bytes([END]) for d in docs)
        text = np.frombuffer(raw, np.uint8)
        order, levels = suffix_ranks(text)
        whole = raw + bytes([BEYOND]) * 8
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: whole[i:])  # noqa: B023
        shared = lambda i, j: next((k for k in range(len(raw)) if max(i, j) + k >= len(raw) or raw[i + k] != raw[j + k]), len(raw))  # noqa: B023, E731
        assert common_prefix(order[:-1], order[1:], text, levels).tolist() == [shared(i, j) for i, j in zip(order[:-1], order[1:], strict=True)]
        times = Counter(d[i : i + window] for d in docs for i in range(len(d) - window + 1))
        wanted = [i + window <= len(d) and times[d[i : i + window]] > 1 for d in docs for i in range(len(d) + 1)]
        assert repeated_windows(text, window).tolist() == wanted


@pytest.mark.parametrize("hot", [1024, 2, 0])
def test_dedup_of_odd_rows(spark, hot):
    texts = [d.decode() for docs in collections(25, WINDOW, 2) for d in docs]
    rnd = random.Random(4)
    shared = "".join(chr(rnd.choice([65, 233, 26085, 128512]) + rnd.randrange(20)) for _ in range(60))
    texts += [f"{i * 7919} a {shared} z {i * 104729}" for i in range(30)] + [shared] * 5 + ["", None, "x" * 39, "y" * 40, "z" * 41, "ab" * 500]
    rows = [(i // 3 or None, t, "s", i, b"k") for i, t in enumerate(texts)]
    got = find_byte_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans string, block int, a binary"), WINDOW, hot).collect()
    raw = [(t or "").encode() for t in texts]
    wanted = Counter()
    for (doc_id, *_), d, gone in zip(rows, raw, marked(raw, WINDOW), strict=True):
        spans = [i for i in range(len(d) + 1) if (i > 0 and gone[i - 1]) != (i < len(d) and bool(gone[i]))]
        wanted[doc_id, len(d), tuple(zip(spans[::2], spans[1::2], strict=True)), bytes(x for x, g in zip(d, gone, strict=True) if not g)] += 1
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == wanted


def test_dedup_of_long_and_no_texts(spark):
    assert not find_byte_repeats(spark.createDataFrame([], "doc_id long, text string")).collect()
    rnd = np.random.default_rng(3)
    long = bytes(rnd.integers(97, 123, 2_500_000, np.uint8))
    other = long[1_048_000:1_049_500]  # across a stretch's edge
    got = {r.doc_id: r for r in find_byte_repeats(spark.createDataFrame([(1, long.decode()), (2, "-" + other.decode() + "+")], "doc_id long, text string")).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(1_048_000, 1_049_500)] and [(s.start, s.end) for s in got[2].spans] == [(1, 1501)]
    assert bytes(got[1].kept) == long[:1_048_000] + long[1_049_500:] and bytes(got[2].kept) == b"-+"
