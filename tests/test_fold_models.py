"""Models of all folds from shared passes, against pyspark.ml's fits of one fold each."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from ledgerline import registry
from ledgerline.functions import fold_models

D = "/root/testdata/sf0.001"


def table(spark, n=700, values=9):
    rng = np.random.default_rng(3)
    x = rng.integers(0, values, (n, 4)).astype(float)
    x[:, 3] = 0.5  # never split
    y = 1000 + np.where(x[:, 0] > 3, 5 * x[:, 1], -2 * x[:, 2]) + rng.normal(0, 1, n)
    active = (rng.random(n) < 1 / (1 + np.exp(3 - x[:, 0]))).astype(float)
    rows = [(i, v.tolist(), float(a), float(b), i * 7 % 3) for i, (v, a, b) in enumerate(zip(x, y, active, strict=True))]
    return spark.createDataFrame(rows, "l_orderkey long, x array<double>, y double, active double, fold long").withColumn("x", array_to_vector("x")).repartition(3).cache()


def test_held_out_scores_are_those_of_single_fits(spark):
    x = table(spark)
    of, classes = {"featuresCol": "x", "labelCol": "y"}, {"featuresCol": "x", "labelCol": "active"}
    models = {"tree": DecisionTreeRegressor(**of, maxDepth=4, seed=7), "boosted": GBTRegressor(**of, maxIter=4, maxDepth=2, seed=7), "classes": GBTClassifier(**classes, maxIter=3, maxDepth=3, seed=7), "logistic": LogisticRegression(**classes, maxIter=50, tol=1e-9)}
    shared = {name: fold_models.described(m) for name, m in models.items()}
    cut, ranges = fold_models.cut_rows(x, 32)
    assert len(ranges.cuts[3]) == 0 and len(ranges.cuts[0]) == 8
    got = {r["l_orderkey"]: r for r in fold_models.held_out(cut.cache(), ranges, shared, range(3), ("l_orderkey", "fold")).collect()}
    assert len(got) == 700
    for name, m in models.items():
        field = vector_to_array("probability")[1] if name in ("classes", "logistic") else F.col("prediction")
        for k in range(3):
            want = m.copy().fit(x.where(F.col("fold") != k)).transform(x.where(F.col("fold") == k)).select("l_orderkey", field.alias("p")).collect()
            assert want and all(got[r["l_orderkey"]][name] == pytest.approx(r["p"], abs=1e-4) for r in want), name


def test_forests_draw_rows_and_inputs_and_predict_as_well(spark):
    x = table(spark)
    forest, classes = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=12, maxDepth=4, seed=7), RandomForestClassifier(featuresCol="x", labelCol="active", numTrees=12, maxDepth=4, seed=7)
    specs = {"forest": fold_models.described(forest), "classes": fold_models.described(classes)}
    cut, ranges = fold_models.cut_rows(x, 32)
    cut = cut.cache()
    told = fold_models.held_out(cut, ranges, specs, range(3), ("y", "active", "fold")).collect()
    error = lambda rows, p, y: np.mean([(r[p] - r[y]) ** 2 for r in rows])
    own = {}
    for name, m, y, field in (("forest", forest, "y", F.col("prediction")), ("classes", classes, "active", vector_to_array("probability")[1])):
        rows = [r for k in range(3) for r in m.fit(x.where(F.col("fold") != k)).transform(x.where(F.col("fold") == k)).select(y, field.alias("p")).collect()]
        own[name] = error(rows, "p", y)
        assert error(told, name, y) < 1.3 * own[name]
    assert all(0 <= r["classes"] <= 1 for r in told)
    trees, _ = fold_models.grown_trees(cut, specs, [0], ranges.cuts)["forest", 0]
    assert len(trees) == 12 and len({tuple(t.input) for t in trees}) > 6


def test_ranges_of_many_values_hold_equal_shares(spark):
    x = spark.createDataFrame([([float(i), float(i % 2)],) for i in range(1000)], "x array<double>").withColumn("x", array_to_vector("x"))
    cut, ranges = fold_models.cut_rows(x, 10)
    counts = np.bincount([r["bins"][0] for r in cut.collect()])
    assert len(counts) == 10 and counts.min() >= 90 and list(ranges.cuts[1]) == [0.5]


def test_bootstrap_weights_are_poisson():
    w = np.array([fold_models._draws(np.arange(20_000), 7, i) for i in range(3)])
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03) and abs(np.corrcoef(w)[0, 1]) < 0.03


def test_only_known_parameters_are_shared():
    assert fold_models.described(GBTRegressor(maxIter=3, subsamplingRate=0.5)) is None
    assert fold_models.described(RandomForestRegressor(weightCol="w")) is None
    assert fold_models.described(LogisticRegression(regParam=0.1)) is None
    assert fold_models.described(LinearRegression()) is None
    assert fold_models.described(DecisionTreeRegressor(labelCol="y", maxDepth=3)).depth == 3


def test_empty_folds_and_missing_targets(spark):
    x = table(spark).withColumn("y", F.when(F.col("l_orderkey") > 30, F.col("y")))
    specs = {"tree": fold_models.described(DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=2))}
    cut, ranges = fold_models.cut_rows(x, 32)
    told = fold_models.held_out(cut, ranges, specs, range(5), ("l_orderkey",)).collect()  # folds 3 and 4 have no rows
    assert len(told) == 700 and all(np.isfinite(r["tree"]) for r in told)
    assert fold_models.held_out(cut.where("fold > 9"), ranges, specs, range(5), ("l_orderkey",)).count() == 0


def test_stacked_classes_are_told_without_a_fit_a_fold(spark, monkeypatch):
    for kind in (GBTClassifier, RandomForestClassifier):
        monkeypatch.setattr(kind, "fit", lambda *_: pytest.fail("a fit of one fold"))
    r = registry.queries()["e16_stacked_classifier"](spark, D).first()
    assert r["n"] > 1000 and 0.6 < r["accuracy"] < 0.85
