"""Periodic runs against all diagonals of a text, source audits against plain integers, both on odd rows and through their queries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import queries, source_audit
from ledgerline.llm.perfect_hash import PerfectHash
from ledgerline.llm.periodic_runs import _numbered, find_runs, runs_of_grams
from ledgerline.llm.source_audit import audit_sources

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def all_runs(w):
    """Every diagonal from end to end; a run's shorter periods are tried one by one."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, size = i - q, j - i + q
            if j > i and size >= max(12, 2 * q) and all(any(w[k] != w[k + p] for k in range(start, start + size - p)) for p in range(1, q)):
                out.append((start, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def odd_texts():
    """Periods within periods, fractions of a period, and stretches that come again elsewhere."""
    rnd = random.Random(11)
    for _ in range(400):
        k, w = rnd.choice([1, 2, 2, 3, 5, 30]), []
        for _ in range(rnd.randint(1, 6)):
            if (c := rnd.random()) < 0.4:
                base = [rnd.randrange(k) for _ in range(rnd.randint(1, 15))]
                w += [base[i % len(base)] for i in range(rnd.randint(1, 60))]
            elif c < 0.6 and w:
                a = rnd.randrange(len(w))
                w += w[a : a + rnd.randint(0, 40)] * rnd.randint(1, 4)
            else:
                w += [rnd.randrange(k) for _ in range(rnd.randint(0, 30))]
        yield [f"w{x}" for x in w[:250]]


def test_runs_of_any_text():
    for w in odd_texts():
        grams = _numbered([x.encode() for x in w])
        assert (runs_of_grams(grams) if grams.size else []) == all_runs(w), w


def test_find_runs_on_odd_rows(spark):
    texts = [" ".join(w) for w in list(odd_texts())[:40]] + [None, "", " \t\n", "a " * 11, "a " * 12, "é  x\n" * 30, "one two three four five six\n" * 20000, "a  b\ta b a b a\nb a b a b"]
    rows = [(i // 2 or None, t, "x", i) for i, t in enumerate(texts)] * 2
    got = find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")).collect()
    say = lambda d, w, runs: (d, len(w), tuple(runs), hashlib.sha256(" ".join(kept_words(w, runs)).encode()).hexdigest())
    wanted = Counter(say(d, w := WORD.findall(t or ""), all_runs(w) if len(w) < 1000 else [(0, 120000, 6)]) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), hashlib.sha256(r.collapsed.encode()).hexdigest()) for r in got) == wanted
    assert not find_runs(spark.createDataFrame([], "doc_id string, text string")).collect()


def test_periodic_runs_query(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, D).collect()}
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    assert sorted(got) == sorted(d.doc_id for d in docs)
    planted = 0
    for d in docs:
        w, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], planted + 1
        if n > 1500:
            continue  # each diagonal at once is too slow here; long texts are in the rows above
        runs, r = all_runs(w), got[d.doc_id]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept_words(w, runs)).encode()).hexdigest()
    assert planted > 5


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    made = PerfectHash.load(*PerfectHash.build(keys).dump())
    assert sorted(made.slots(keys).tolist()) == list(range(n))
    assert made.slots(keys + np.uint64(1)).max(initial=-1) < max(n, 1)
    if n:
        with pytest.raises(ValueError, match="alike"):
            PerfectHash.build(np.append(keys, keys[0]))


def plain_audit(rows, least):
    counts, df = defaultdict(Counter), Counter()
    for text, lang, source in rows:
        terms = ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(terms)
        df.update((lang or "", t) for t in set(terms))
    out = set()
    for lang in {k[0] for k in counts}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, p = share(sum(groups.values(), Counter())), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else 50]):
                    out.add((lang, s, part, item, v, i + 1))
    return out


def audit_rows():
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("Al", "Be", "ça", "Ö", "日", "z ") for b in ("", "x", "Yy", "é")]
    rows = [(" 1-".join(rnd.choices(words, k=rnd.randint(0, 30))), rnd.choice(["en", "en", "fr", None]), rnd.choice(["a", "b", "é", "", None, "hot", "hot"])) for _ in range(300)]
    return [*rows, *rows[:20], (None, "en", "a"), ("", "alone", "one"), ("word", "rare", "s1"), ("word", "rare", "s2"), (None, None, None)]


def test_audit_of_odd_rows(spark, monkeypatch):
    rows = audit_rows()
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string")
    wanted = plain_audit(rows, 5)
    read = lambda df: {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()}
    assert read(audit_sources(frame, 5)) == wanted
    for name, size in (("SHARD_CELLS", 100), ("BROADCAST_BYTES", 1500), ("DENSE_BYTES", 500), ("HELD_TERMS", 3)):  # many shards, rounds and flushes
        monkeypatch.setattr(source_audit, name, size)
    assert read(audit_sources(frame, 5)) == wanted
    assert not audit_sources(spark.createDataFrame([], "text string, lang string, source string")).collect()


def test_shares_stay_exact():
    for c, n, v in ((0, 0, 1), (7, 10**12, 10**6), (9 * 10**14, 9 * 10**14, 3), (123456789, 987654321987, 77)):
        assert int(source_audit.shares(np.array([c]), np.array([n]), v)[0]) == 1 + 10**9 * (c + 5) // (n + 5 * v)
