"""Exact neighbour search, the model on it, and the applicability domain, against plain numpy."""

import re

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerline.functions import neighbour_model, neighbours
from ledgerline.functions.neighbour_model import NeighbourModel, NeighbourRegressor
from ledgerline.plans import domain


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize(("n", "width", "k", "grid"), [(900, 3, 4, True), (700, 8, 1, False), (6, 2, 9, True), (400, 2, 3, None)])
def test_nearest_rows(spark, monkeypatch, n, width, k, grid):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)  # many cells and rings on little data
    rng = np.random.default_rng(n)
    x = np.ones((n, width)) if grid is None else rng.integers(0, 4, (n, width)).astype(float) if grid else rng.normal(0, 1, (n, width)) * 1e3
    q = np.vstack([x[:20], rng.normal(0, 2, (20, width)), np.full((1, width), 1e6)])
    got = {r.id: [(a.distance, a.id) for a in r.near] for r in neighbours.nearest(frame(spark, x), frame(spark, q), k).collect()}
    for i, v in enumerate(q):
        away = np.sqrt(((x - v) ** 2).sum(1))
        best = np.lexsort((np.arange(n), away))[:k]
        assert [j for _, j in got[i]] == best.tolist()
        assert [d for d, _ in got[i]] == pytest.approx(away[best])


def test_few_boxes_are_near(spark, monkeypatch):
    """Columns of very different spread, as in the fused matrix: most queries need one box or two, so their number grows no faster than the rows'."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (3000, 12)) * np.array([2000, 400] + [1.0] * 10)
    tree = neighbours.grown(x, 50)
    box = neighbours.fallen(tree, x)
    sizes = np.bincount(box)
    assert sizes.sum() == 3000 and 0 < sizes.min() and sizes.max() <= 50
    low, high = (np.array([f(x[box == b], axis=0) for b in range(len(sizes))]) for f in (np.min, np.max))
    met = 0
    for v, b in zip(x[::30], box[::30], strict=True):
        kth = np.sort(((x[box == b] - v) ** 2).sum(1))[4]
        met += ((np.maximum(0, np.maximum(low - v, v - high)) ** 2).sum(1) <= kth).sum()
    assert met / 100 < 10 < len(sizes) / 5  # of more than fifty boxes


def test_nearest_without_training_rows(spark):
    empty = spark.createDataFrame([], "id long, x array<double>")
    assert [r.near for r in neighbours.nearest(empty, frame(spark, np.ones((2, 3))), 3).collect()] == [[], []]
    assert neighbours.nearest(frame(spark, np.ones((2, 3))), empty, 3).count() == 0


def plain_prediction(x, y, v, k):
    away = np.sqrt(((x - v) ** 2).sum(1))
    best = np.lexsort((y, away))[:k]
    if away[best[0]] == 0:
        same = best[away[best] == 0]
        return y[same].mean()
    return (y[best] / away[best]).sum() / (1 / away[best]).sum()


def test_neighbour_model(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 5, (300, 2)) + np.array([0.0, 0.25]), rng.normal(0, 1, 300)
    x[200:] += rng.normal(0, 1, (100, 2))
    q = np.vstack([x[:30], rng.normal(2, 2, (30, 2)), x[:5]])
    rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)] + [(Vectors.dense([0, 0]), None)], ["x", "y"])
    asked = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(q)], ["i", "x"])
    model = NeighbourRegressor(featuresCol="x", labelCol="y", k=5).fit(rows)
    model.write().overwrite().save(f"{tmp_path}/model")
    for m in (model, NeighbourModel.load(f"{tmp_path}/model")):
        got = {r.i: r.prediction for r in m.transform(asked).collect()}
        assert len(got) == len(q)
        for i, v in enumerate(q):
            assert got[i] == pytest.approx(plain_prediction(x, y, v, 5)), i


def test_domain_of_any_columns(spark):
    rng = np.random.default_rng(4)
    train = rng.normal(0, 1, (300, 3)) * [1, 10, 100]
    train = np.column_stack([train, np.full(300, 0.6), 2 * train[:, 0]])  # a constant and a dependent column
    rows = np.vstack([train[:40], train[:40] + [0.1, 1, 3, 0, 0.2], train[:10] * [9, 9, 9, 1, 9]])
    names = tuple("abcde")
    make = lambda m: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], ["i", *names])
    got = {r.i: r for r in domain.domain(make(rows), make(train), names).collect()}
    scale = np.where(np.ptp(train, axis=0) == 0, 0, train.std(0)) + 1e-8
    z, w = (train - train.mean(0)) / scale, (rows - train.mean(0)) / scale
    z[:, 3], w[:, 3] = 0, 0
    inverse = np.linalg.inv(np.cov(z, rowvar=False) + 1e-6 * np.eye(5))
    away = np.linalg.norm(z, axis=1)
    edge, mean = np.percentile(away, 95), away.mean()
    for i, v in enumerate(w):
        distance = np.sqrt(v @ inverse @ v)
        assert got[i].distance == pytest.approx(distance, rel=1e-5)
        assert got[i].nearest == pytest.approx(np.linalg.norm(z - v, axis=1).min(), abs=1e-6)
        assert got[i].leverage == pytest.approx(distance / (edge + 1e-8), rel=1e-5)
        assert got[i].label == ("high" if distance <= mean else "medium" if distance <= edge else "low" if distance <= 1.5 * edge else "out_of_domain")
        # the rule that decides nothing
        apart = np.linalg.norm(z - v, axis=1)
        assert apart.min() <= np.percentile(apart, 90) + 3 * away.std()
    assert {r.label for r in got.values()} >= {"high", "medium", "out_of_domain"}
    assert domain.covariance(make(train).select(F.array("a", "b").alias("x")), "x", 2) == pytest.approx(np.cov(train[:, :2], rowvar=False))


def test_rows_of_one_number_are_left_out(spark):
    rng = np.random.default_rng(4)
    x, q = np.vstack([rng.normal(0, 1, (1400, 3)), np.zeros((30, 3))]), rng.normal(0, 1, (60, 3))
    only, of = rng.integers(-1, 3, len(x)), rng.integers(-1, 3, len(q))
    q[:10], of[:10] = 0, 1
    number = lambda t, v: t.join(spark.createDataFrame([(i, int(a)) for i, a in enumerate(v)], "id long, only int"), "id")
    got = {r.id: [a.id for a in r.near] for r in neighbours.nearest(number(frame(spark, x), only), number(frame(spark, q), of), 6).collect()}
    for i, v in enumerate(q):
        away = np.where((only == of[i]) & (only >= 0), np.inf, np.sqrt(((x - v) ** 2).sum(1)))
        assert got[i] == np.lexsort((np.arange(len(x)), away))[:6].tolist()


def test_means_of_all_groups_from_one_search(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (400, 3)).astype(float)
    x[:60] = [9, 9, 9]  # more equal rows than neighbours
    rows = [(i, v.tolist(), None if i % 29 == 0 else float(rng.normal()), int(g)) for i, (v, g) in enumerate(zip(x, rng.integers(0, 4, 400), strict=True))]
    rows += [(400 + i, [20.0, float(i), 0.0], float(i), 2) for i in range(8)]  # neighbours of one group only
    t = spark.createDataFrame(rows, "i int, x array<double>, y double, fold int").withColumn("x", array_to_vector("x")).cache()
    model = NeighbourRegressor(featuresCol="x", labelCol="y", k=5)
    searched, real = [], neighbours.nearest
    monkeypatch.setattr(neighbour_model, "nearest", lambda *a: searched.append(a) or real(*a))
    got = {r.i: r.prediction for r in model.held_out(t, "fold").collect()}
    assert len(searched) == 1 and set(got) == set(range(408))
    for k in range(4):
        for r in model.fit(t.where(F.col("fold") != k)).transform(t.where(F.col("fold") == k)).collect():
            own = [(np.sqrt(((np.array(v) - r.x.toArray()) ** 2).sum()), y) for _, v, y, g in rows if g != k and y is not None]
            own.sort()
            if own[4][0] < own[5][0] or own[4][0] == 0:  # no tie of different rows at the last place
                assert got[r.i] == pytest.approx(r.prediction, abs=1e-12)


def test_greatest_products(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(0, 1, (200, 3)) * rng.uniform(0.1, 4, (200, 1)), np.tile([3.0, 0, 0], (40, 1)), np.zeros((2, 3))])  # forty rows that tie
    q = np.vstack([rng.normal(0, 1, (10, 3)), [[1, 0, 0], [0, 0, 0], [-1, 0, 0]]])
    got = {}
    for r in neighbours.greatest_products(frame(spark, x), frame(spark, q), 5).collect():
        got.setdefault(r.query, {})[r["rank"]] = (r.id, r.score)
    for i, v in enumerate(q):
        score = np.round(x @ v, 6) + 0.0
        best = np.lexsort((np.arange(len(x)), -score))[:5]
        assert [got[i][n + 1][0] for n in range(5)] == best.tolist()
        assert [got[i][n + 1][1] for n in range(5)] == pytest.approx(score[best])
    assert neighbours.greatest_products(frame(spark, x).limit(0), frame(spark, q), 5).count() == 0


def test_the_tree_is_grown_in_a_task(spark, monkeypatch):
    grown = neighbours.grown

    def watched(*given):
        assert TaskContext.get() is not None, "the driver grows the tree"
        return grown(*given)

    monkeypatch.setattr(neighbours, "grown", watched)
    x = np.random.default_rng(8).normal(size=(1500, 4))
    got = {r.id: [a.id for a in r.near] for r in neighbours.nearest(frame(spark, x), frame(spark, x[:20] + 1e-9), 1).collect()}
    assert got == {i: [i] for i in range(20)}


def test_vectors_of_a_domain_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, float(i % 50), float(i % 7)) for i in range(300)], "id long, a double, b double")
    plan = domain.domain(rows, rows.where("id % 5 <> 0"), ("a", "b"))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line and re.search(r"\b(x|id|box)#", line)]
    assert joins and all("SortMergeJoin" in line for line in joins), joins


def test_a_domain_stores_different_vectors_only(spark, monkeypatch):
    stored, real = [], domain.written

    def watched(t):
        out = real(t)
        stored.append(out.count())
        return out

    monkeypatch.setattr(domain, "written", watched)
    rows = spark.createDataFrame([(i, float(i % 20), float(i % 5)) for i in range(300)], "id long, a double, b double")
    out = domain.domain(rows, rows.where("id % 7 <> 0"), ("a", "b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert stored and max(stored) <= 20 and out.count() == 300  # of 300 lines
    assert not [line for line in plan.splitlines() if "Join " in line and re.search(r"\bx#", line)]
