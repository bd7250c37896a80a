"""Model fits, which have no SQL twin."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerline import registry
from ledgerline.plans import attribution, models

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("rows", "clusters"), [(40, 5), (120, 12), (300, 20)])
def test_clusters_grow_with_the_rows(spark, tmp_path, rows, clusters):
    d, real = str(tmp_path), "/root/testdata/sf0.001"
    spark.read.parquet(f"{real}/part.parquet").write.parquet(f"{d}/part.parquet")
    spark.read.parquet(f"{real}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(rows).write.parquet(f"{d}/lineitem.parquet")
    got = registry.queries()["e6_cluster_holdout"](spark, d).collect()
    assert len(got) == clusters and sum(r.n for r in got) == rows
    assert sum(r.test for r in got) == clusters // 5


def test_a_small_table_is_split_by_clusters(spark, tmp_path):
    d, real = str(tmp_path), "/root/testdata/sf0.001"
    spark.read.parquet(f"{real}/part.parquet").write.parquet(f"{d}/part.parquet")
    spark.read.parquet(f"{real}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(12).write.parquet(f"{d}/lineitem.parquet")
    got = {r.test: (r.n, r.groups) for r in registry.queries()["e5_group_holdout"](spark, d).collect()}
    assert sum(n for n, _ in got.values()) == 12 and sum(g for _, g in got.values()) == 5  # the five clusters of a small table, not its parts


def test_a_fit_reads_its_rows_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_A_FILE", 700)
    x = models.training(spark, D)
    each = [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 6000 and max(each) <= 700


def test_vectors_are_those_of_the_assembler_without_broken_rows(spark):
    t = spark.createDataFrame([(1, 0.5, 2.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 0.0, float("inf"))], "i int, a double, b double")
    want = VectorAssembler(inputCols=["a", "b"], outputCol="x", handleInvalid="skip").transform(t).collect()
    assert [(r.i, list(r.x)) for r in models.assembled(t, ["a", "b"]).collect()] == [(r.i, list(r.x)) for r in want] == [(1, [0.5, 2.0]), (4, [0.0, float("inf")])]


def test_ridge_folds_of_one_pass_are_those_of_the_fits(spark, monkeypatch):
    x = models.training(spark, D)
    got = {r["name"]: r for r in models.ridge_by_moments(x, 5, 1.0).collect()}
    ridge = lambda: models.scaled(models.regressors()["ridge"])
    for name, fit, held in (("3", x.where("fold <> 3"), x.where("fold = 3")), ("all", x, x)):
        want = models.scored(ridge().fit(fit).transform(held)).first()
        assert got[name]["n"] == want["n"] and got[name]["rmse"] == pytest.approx(want["rmse"], rel=1e-9) and got[name]["r2"] == pytest.approx(want["r2"], abs=1e-9)
    few = {r["name"]: r["error"] for r in models.ridge_by_moments(x.where("fold <> 3"), 5, 1.0).collect()}
    assert [k for k, e in few.items() if e] == ["3"]
    assert {r["error"] for r in models.ridge_by_moments(x.where("fold > 9"), 5, 1.0).collect()} == {"no rows"}
    monkeypatch.setattr(models, "side_by_side", None)  # the query makes no fit a fold
    assert registry.queries()["e9_cross_validation"](spark, D).first()["folds"] == 5


def test_the_matrix_of_explained_lines_is_made_once(spark, monkeypatch):
    made, real = [], models.matrix
    count = lambda *a: made.append(a) or real(*a)
    monkeypatch.setattr(models, "matrix", count)
    monkeypatch.setattr(attribution, "matrix", count)
    assert registry.queries()["f12_model_explain"](spark, D).count() == 5 * len(models.INPUTS) and len(made) == 1


def test_linear_models_of_one_pass_are_those_of_the_fits(spark):
    x = models.training(spark, D).cache()
    linear = {n: m for n, m in models.regressors().items() if n in ("ridge", "lasso", "elastic_net")}
    linear["strong"] = models.LinearRegression(featuresCol="x", labelCol="y", regParam=300.0, elasticNetParam=0.7)
    got = {r[0]: r for r in models._linear_metrics(x, linear)}
    for name, m in linear.items():
        exact = m.copy({m.tol: 1e-13, m.maxIter: 3000})  # with the default tolerance the fit stops some 1e-5 earlier
        want = models.scored(exact.fit(x.where("fold > 0")).transform(x.where("fold = 0"))).first()
        assert got[name][1] == want["n"] and got[name][2] == pytest.approx(want["rmse"], rel=1e-6) and got[name][3] == pytest.approx(want["r2"], abs=1e-6), name


def test_lasso_leaves_out_what_adds_little():
    like, toward = np.array([[1.0, 0.5], [0.5, 1.0]]), np.array([1.0, 0.55])
    assert models.shrunk(like, toward, 0.2, 1.0) == pytest.approx([0.8, 0.0])
    b = models.shrunk(like, toward, 0.01, 0.5)
    assert like @ b - toward + 0.005 * np.sign(b) + 0.005 * b == pytest.approx([0, 0], abs=1e-9)


def test_a_benchmark_makes_no_fit_of_what_shares_passes(spark, monkeypatch):
    for kind in (models.LinearRegression, models.DecisionTreeRegressor, models.RandomForestRegressor, models.GBTRegressor):
        monkeypatch.setattr(kind, "fit", lambda *_: pytest.fail("a fit of its own"))
    got = {r["model"]: r for r in models.model_benchmark(spark, D).collect()}
    assert set(got) == set(models.regressors()) and not any(r["error"] for r in got.values())
    assert len({r["n"] for r in got.values()}) == 1 and all(-1 < r["r2"] < 0.1 for r in got.values())
