"""The best documents of a scan are those of all pairs, and no row of a pair is shuffled."""

import random

import numpy as np
import pytest

from ledgerline.functions import scan
from ledgerline.plans import retrieval


@pytest.mark.parametrize(("at_once", "step", "k"), [(1024, 1 << 20, 5), (4, 8, 1), (3, 1, 7)])
def test_best_of_all_pairs(spark, monkeypatch, at_once, step, k):
    monkeypatch.setattr(scan, "AT_ONCE", at_once)
    monkeypatch.setattr(scan, "STEP", step)
    rnd = random.Random(k)
    some = lambda: {t: rnd.choice([0.25, 0.5, 1.0]) for t in rnd.sample(range(12), rnd.randint(1, 6))}
    docs, asked = [some() for _ in range(120)], [*(some() for _ in range(10)), {99: 1.0}]
    docs += docs[:30]  # ties
    rows = [(i, np.array(sorted(x), np.int32).tobytes(), np.array([x[t] for t in sorted(x)]).tobytes()) for i, x in enumerate(docs)]
    vectors = spark.createDataFrame([*rows, (None, rows[0][1], rows[0][2])], scan.VECTOR)
    questions = spark.createDataFrame([(i, t, w) for i, q in enumerate(asked) for t, w in q.items()], "item_id long, term int, qw double")
    found = scan.best_documents(vectors, questions, k)
    got = {}
    for r in found.collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    for i, q in enumerate(asked):
        best = sorted(s for s in ((-round(sum(w * q.get(t, 0) for t, w in x.items()), 6), j) for j, x in enumerate(docs)) if s[0] < 0)[:k]
        assert sorted(got.get(i, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)], i


def test_no_documents_and_no_questions(spark):
    none = spark.createDataFrame([], "item_id long, term int, qw double")
    assert not scan.best_documents(spark.createDataFrame([], scan.VECTOR), none, 3).collect()
    assert not scan.best_documents(spark.createDataFrame([(1, np.zeros(1, np.int32).tobytes(), np.ones(1).tobytes())], scan.VECTOR), none, 3).collect()


def test_a_repeated_id_has_the_words_of_all_its_texts(spark):
    docs = spark.createDataFrame([(1, "red green"), (1, "green blue"), (2, "blue"), (3, None)], "doc_id long, text string")
    vocabulary = spark.createDataFrame([(0, "blue", 1.0), (1, "green", 2.0), (2, "red", 3.0), (3, "red green", 1.0), (4, "green green", 9.0)], "number int, term string, idf double")
    got = {r.doc_id: (r.terms, round(r.norm**2, 9), np.frombuffer(r.ids, np.int32).tolist()) for r in retrieval.tfidf_vectors(docs, vocabulary).collect()}
    assert got == {1: (4, 1 + 16 + 9 + 1, [0, 1, 2, 3]), 2: (1, 1.0, [0])}


def test_documents_are_not_shuffled_by_pairs(spark):
    plan = retrieval.tfidf_vectors(spark.createDataFrame([(1, "red green")], "doc_id long, text string"), spark.createDataFrame([(0, "red", 1.0)], "number int, term string, idf double"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("at_once", "step"), [(1024, 1 << 20), (4, 8)])
def test_greatest_likeness_of_all_pairs(spark, monkeypatch, at_once, step):
    monkeypatch.setattr(scan, "AT_ONCE", at_once)
    monkeypatch.setattr(scan, "STEP", step)
    rnd = random.Random(step)
    some = lambda: {f"t{t}" for t in rnd.sample(range(14), rnd.randint(1, 9))}
    docs, asked = {i: some() for i in range(150)}, {i: some() for i in range(9)} | {20: {"none"}}
    asked[9], asked[10] = set(docs[3]), {f"t{i}" for i in range(14)} | {f"u{i}" for i in range(6)}
    docs[200] = {f"t{i}" for i in range(14)} | {f"u{i}" for i in range(4)}  # 18 of 20: not above 9/10
    rows = [(i, sorted(x)) for i, x in docs.items()] + [(300, None), (301, []), (None, ["t1"]), (400, ["t1", "t2"]), (400, ["t2", "t3"])]
    docs[400] = {"t1", "t2", "t3"}  # a number that is repeated is one set
    sets, questions = spark.createDataFrame(rows, "doc_id long, terms array<string>"), spark.createDataFrame([(i, sorted(x)) for i, x in asked.items()] + [(None, ["t1"])], "item_id long, terms array<string>")
    got = {r.item_id: (r.most, r.n) for r in scan.greatest_likeness(sets, questions, (9, 10)).collect()}
    assert set(got) == set(asked) - {20}
    for i in got:
        pairs = [(len(asked[i] & d), len(asked[i] | d)) for d in docs.values() if asked[i] & d]
        assert got[i] == (pytest.approx(max(a / b for a, b in pairs)), sum(10 * a > 9 * b for a, b in pairs)), i


def test_split_leaks_shuffle_no_words(spark):
    from ledgerline import registry

    plan = registry.queries()["e24_split_leaks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "Generate" not in plan and plan.count("Exchange") == 1  # one row a question and task


def test_no_sets_and_no_questions(spark):
    none, one = spark.createDataFrame([], "item_id long, terms array<string>"), spark.createDataFrame([(1, ["a"])], "doc_id long, terms array<string>")
    assert not scan.greatest_likeness(one, none, (9, 10)).collect()
    assert not scan.greatest_likeness(one.limit(0), one.withColumnRenamed("doc_id", "item_id"), (9, 10)).collect()
