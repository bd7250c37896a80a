"""Searches that stop by bounds give what scoring every pair gives."""

import random

import pytest

from ledgerline.functions import postings
from ledgerline.functions.postings import Postings


@pytest.fixture(params=[(512, 4096), (3, 6), (1, 1)])
def sizes(request, monkeypatch):
    for name, size in zip(("BLOCK", "START"), request.param, strict=True):
        monkeypatch.setattr(postings, name, size)


def corpus(seed, docs, words):
    """Few common words, many rare ones, and documents that share passages."""
    rnd = random.Random(seed)
    out = []
    for _ in range(docs):
        w = {min(int(rnd.paretovariate(0.7)), words) for _ in range(rnd.randint(0, 25))}
        if out and rnd.random() < 0.3:
            w |= rnd.choice(out)
        out.append(w)
    return out


def test_top_of_all_pairs(spark, sizes):
    rnd = random.Random(1)
    docs = [{f"t{w}": round(rnd.uniform(0.1, 3), 3) for w in d} for d in corpus(2, 150, 60)]
    asked = [{f"t{w}": round(rnd.uniform(0.1, 2), 3) for w in d} for d in [*corpus(3, 12, 60), {999}, {1}]]
    frame = lambda x, names: spark.createDataFrame([(i, t, w) for i, own in enumerate(x) for t, w in own.items()], f"{names[0]} long, term string, {names[1]} double")
    index = Postings.build(frame(docs, ("doc_id", "w")))
    for k in (1, 5):
        got = {}
        for r in index.top(frame(asked, ("item_id", "qw")), k).collect():
            got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
        for i, q in enumerate(asked):
            scores = [(-round(sum(w * q.get(t, 0) for t, w in d.items()), 6), j) for j, d in enumerate(docs)]
            best = sorted(s for s in scores if s[0] < 0)[:k]
            assert [(j, s) for _, j, s in sorted(got.get(i, []))] == [(j, pytest.approx(-s)) for s, j in best], i


def test_most_alike_of_all_pairs(spark, sizes):
    docs = [{f"t{w}" for w in d} for d in corpus(4, 150, 60)]
    asked = [{f"t{w}" for w in d} for d in corpus(5, 12, 60)] + [docs[3], docs[3] | {"zz"}, {"none"}]
    flat = lambda x, name: spark.createDataFrame([(i, t) for i, own in enumerate(x) for t in own], f"{name} long, term string")
    index = Postings.build(flat(docs, "doc_id").selectExpr("doc_id", "term", "1.0D AS w"))
    got = {}
    for r in index.most_alike(flat(asked, "item_id"), 0.9).collect():
        assert (r.i, r.a, r.b) == (len(asked[r.item_id] & docs[r.doc_id]), len(asked[r.item_id]), len(docs[r.doc_id]))
        got.setdefault(r.item_id, []).append(r.i / (r.a + r.b - r.i))
    for i, q in enumerate(asked):
        alike = [len(q & d) / len(q | d) for d in docs if q & d]
        assert max(got.get(i, [0])) == max(alike, default=0)
        assert sorted(s for s in got.get(i, []) if s > 0.9) == sorted(s for s in alike if s > 0.9)
