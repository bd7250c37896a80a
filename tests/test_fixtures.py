"""Rare branches on small fixtures: what the given tables never hold."""

import hashlib
import math

import duckdb
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ledgerline import registry
from ledgerline.functions.running import average_ranks, exact_quantile, running
from ledgerline.plans import attribution, catalogue, docking, evidence, models, structures
from ledgerline.sources import files

D = "/root/testdata/sf0.001"


def test_alerts_of_structure_strings(spark):
    rows = [("C1OC1CC", ["epoxide", "epoxide"]), ("OOc1ccccc1", ["catechol_A(92)"]), ("CS=C1NC", ["rhodanine(0)"]), ("C1OC1S=COOc1ccccc1", ["catechol_A(92)", "rhodanine(0)", "epoxide", "epoxide"]), ("CCO", []), ("", [])]
    got = spark.createDataFrame([(s,) for s, _ in rows], "s string").select("s", structures.alert_names(F.col("s")).alias("a")).collect()
    assert {r.s: r.a for r in got} == dict(rows)


def test_rows_with_errors_stay(spark):
    t = spark.createDataFrame([(1, "CC(=O)N"), (2, None), (3, "CC(=O"), (4, "")], "p_partkey long, s string")
    got = {r.p_partkey: (r.error, r.mw is None) for r in structures.described_or_failed(t).collect()}
    assert got == {1: (None, False), 2: ("no structure", True), 3: ("invalid", True), 4: ("no structure", True)}


def test_counts_that_sum_to_a_whole_number_are_not_cut_below_it(spark, tmp_path):
    # three acceptors and a uniform number of 0.2: 0.6 * 3 + 0.2, as doubles, is below 2; the second row has twelve and 0.8
    rows = [(323797, "cone bolt", "SMALL"), (100, "F" * 12, "")]
    rows[1] = (next(k for k in range(100000) if hashlib.md5(f"{rows[1][1]}|b|{k}".encode()).digest()[3] == 51), rows[1][1], "b")
    t = spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string")
    t.write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("c4_descriptors", "c5_qsar_features"):
        want = {r[0]: r[1] for r in db.execute(f"SELECT p_partkey, hba FROM ({registry.oracle_sql()[name]})").fetchall()}
        assert {r.p_partkey: r.hba for r in registry.queries()[name](spark, str(tmp_path)).collect()} == want
    assert want[rows[1][0]] == 8


def test_finite_values(spark):
    rows = [(1, float("nan")), (2, float("inf")), (3, float("-inf")), (4, 2.5), (5, None)]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, v double").select("i", models.finite(F.col("v")).alias("x")).collect()}
    assert got == {1: 0.0, 2: 10.0, 3: -10.0, 4: 2.5, 5: None}


def test_bad_lines_are_dropped(spark, tmp_path):
    atoms = ["ATOM      1  CA  GLY A   3      12.500   1.000  -2.250", "ATOM      2  CA  GLY A   3         ***   1.000  -2.250", "REMARK", "HETATM    4  CA  GLY A   5       1.000   1.000   1.000"]
    spark.createDataFrame([(a,) for a in atoms], "value string").write.text(f"{tmp_path}/atoms")
    assert {r.serial for r in files.read_coordinates(spark, f"{tmp_path}/atoms").collect()} == {1, 4}
    spark.createDataFrame([("1", "2.5"), ("2", "n/a"), ("3", None)], "k string, v string").write.option("header", True).csv(f"{tmp_path}/rows")
    assert [r.k for r in files.read_training(spark, f"{tmp_path}/rows", ("v",)).collect()] == ["1"]


def test_a_broken_off_stage_is_built_again(spark, tmp_path):
    path = f"{tmp_path}/stage"
    spark.range(3).write.parquet(f"{path}/rows")  # rows without the mark
    assert files.resume(spark, path, lambda: spark.range(5)).count() == 5
    assert files.resume(spark, path, lambda: spark.range(9)).count() == 5


def test_property_search_takes_each_predicate(spark):
    t = spark.createDataFrame([(1, "red root", "Herb", "CCO", 0.6, 200.0, 1, 1, 1.0), (2, "blue leaf", "Tree", "CNC", None, 900.0, 9, 20, 7.0), (3, "red leaf", "Tree", "CCO", 0.9, 300.0, 1, 1, 1.0)], "p_partkey long, p_name string, p_type string, s string, qed double, mw double, hbd int, hba int, logp double")
    ids = lambda **kw: [r.p_partkey for r in catalogue.property_filter(t, **kw).collect()]
    assert ids() == [3, 1, 2] and ids(limit=1) == [3]
    assert ids(name="RED") == [3, 1] and ids(kind="tree") == [3, 2] and ids(use="root") == [1] and ids(structure="CN") == [2]
    assert ids(least_score=0.5) == [3, 1] and ids(least_score=0.0) == [3, 1, 2] and ids(most_weight=250) == [1] and ids(lipinski=False) == [2] and ids(lipinski=True) == [3, 1]


def test_subgraph_keeps_edges_with_both_ends(spark):
    nodes = spark.createDataFrame([("p1", "plant", "neem"), ("p2", "plant", "tulsi"), ("c1", "compound", "x"), ("c2", "compound", "y")], "id string, type string, label string")
    edges = spark.createDataFrame([("p1", "c1"), ("p1", "c2"), ("p2", "c1")], "source string, target string")
    kept, inside = catalogue.subgraph(nodes, edges, None, None, most=3)
    assert {r.id for r in kept.collect()} == {"p1", "p2", "c1"} and {(r.source, r.target) for r in inside.collect()} == {("p1", "c1"), ("p2", "c1")}
    assert {r.id for r in catalogue.subgraph(nodes, edges, "plant", "TUL")[0].collect()} == {"p2"}


def test_empty_input_is_a_critical_issue(spark):
    none = spark.createDataFrame([], "event_id long, severity string, check_name string")
    assert [tuple(r) for r in evidence.with_empty(none, none).collect()] == [(None, "critical", "no_outputs")]
    assert evidence.with_empty(none, spark.range(2)).count() == 0


def test_unknown_candidates_only_count_alone(spark):
    t = spark.createDataFrame([(None, 1.0), (3, 2.0)], "user_id long, score double")
    assert [r.user_id for r in evidence.known_candidates(t, "user_id").collect()] == [3]
    assert evidence.known_candidates(t.where("user_id is null"), "user_id").count() == 1


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [5.0] * 40 + [1e12, -1e12, 0.0], [float(i * i % 97) for i in range(500)]])
def test_ranks_and_quantiles(spark, values):
    t = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    order = sorted(values)
    for share in (0.0, 0.3, 0.5, 0.95, 1.0):
        at = (len(order) - 1) * share
        low = math.floor(at)
        want = order[low] + (at - low) * (order[min(low + 1, len(order) - 1)] - order[low])
        assert exact_quantile(t, "v", share).first()[0] == pytest.approx(want)
    got = {r.i: r.r for r in average_ranks(t, "v", "r").collect()}
    assert got == {i: order.index(v) + (order.count(v) + 1) / 2 for i, v in enumerate(values)}
    sums = {r.v: r.up_to_n for r in running(t.groupBy("v").agg(F.count("*").alias("n")), "v", ("n",)).collect()}
    assert sums == {v: sum(x <= v for x in values) for v in values}


def test_occlusion_of_a_linear_model_is_its_coefficients(spark):
    t = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "k int, a double, b double")
    got = attribution.occluded(t, ["a", "b"], lambda rows: rows.withColumn("prediction", 2 * F.col("a") - 3 * F.col("b")), ["k"]).collect()
    mean_a, mean_b = sum(range(20)) / 20, sum(i * i % 7 for i in range(20)) / 20
    for r in got:
        assert r.change == pytest.approx(2 * (r.k - mean_a) if r.feature == "a" else -3 * (r.k * r.k % 7 - mean_b))
    assert len(got) == 40


def test_fits_that_fail_are_rows(spark):
    x = models.training(spark, D)
    job = lambda k: lambda: models.scored(models.regressors()["ridge"].fit(x.where(f"fold = {k}")).transform(x))
    got = {r.name: r for r in models.side_by_side(spark, {"good": job(1), "none": job(99)}).collect()}
    assert got["good"].error is None and got["good"].n == x.count() and got["none"].error and got["none"].rmse is None
    every = {r.name: r for r in models.side_by_side(spark, {"none": job(98), "nothing": job(99)}).collect()}
    assert len(every) == 2 and all(r.error for r in every.values())


def test_each_tree_of_a_forest(spark):
    """One pass over all trees gives what each tree's own transform gives, and their mean is the forest's prediction."""
    x = models.training(spark, D).limit(500)
    model = models.RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=6, maxDepth=4, seed=3).fit(x)
    trees = models.leaf_values(model)
    assert len(trees) == 6 and all(len(own) > 1 for own in trees)
    got = {r.l_orderkey: r for r in models.by_tree(x, model, "each").dropDuplicates(["l_orderkey"]).collect()}
    for i, tree in enumerate(model.trees):
        own = {tuple(r.x): r.prediction for r in tree.transform(x).collect()}
        assert all(r.each[i] == pytest.approx(own[tuple(r.x)]) for r in got.values())
    assert all(sum(r.each) / 6 == pytest.approx(r.prediction) for r in got.values())


def test_model_queries(spark):
    """Invariants of the fits, which have no SQL twin."""
    q = registry.queries()
    n = spark.read.parquet(f"{D}/lineitem.parquet").count()
    cv = q["e9_cross_validation"](spark, D).first()
    assert (cv.folds, cv.failed, cv.n) == (5, 0, n) and cv.refit_rmse <= cv.rmse * 1.02
    importance = q["f6_global_importance"](spark, D).collect()
    assert sum(r.importance for r in importance) == pytest.approx(1) and len(importance) == len(models.INPUTS)
    saved = q["a14_saved_model"](spark, D).first()
    assert saved.n == n and saved.difference == 0 and saved.features == ";".join(models.INPUTS)
    assert all(0 <= r.accuracy <= 1 and 0 <= r.balanced <= 1 and 0 <= r.f1 <= 1 for r in q["e15_classifiers"](spark, D).collect())
    board = {r.model: r for r in q["e12_model_benchmark"](spark, D).collect()}
    best = q["e13_best_model"](spark, D).first()
    assert set(board) == set(models.regressors()) and best.by_rmse == min(board, key=lambda m: (board[m].rmse, m))
    p = q["e17_batch_predict"](spark, D).collect()
    assert len(p) == n and all((r.prediction == 0.0) == (r.error is not None) for r in p)
    assert all(r.uncertainty >= 0.2 for r in q["e18_ensemble_uncertainty"](spark, D).collect())
    rescored = q["e25_forest_rescoring"](spark, D).collect()
    assert len(rescored) == n and all(-12 <= r.rescored <= -4 and r.confidence == max(0.1, min(0.95, 1 - r.variance)) for r in rescored)
    assert q["f2_model_occlusion"](spark, D).count() == n * len(models.INPUTS)


def test_single_model_has_the_fallback_uncertainty(spark):
    assert {r.uncertainty for r in models.ensemble_uncertainty(spark, D, names=("ridge",)).collect()} == {0.5}


def test_surrogate_of_a_linear_model_is_its_coefficients(spark):
    t = spark.createDataFrame([(i, float(i * 37 % 101), float(i * i % 89) * 3, 7.0) for i in range(60)], "k long, a double, b double, c double")
    got = attribution.surrogate(t, "k", ["a", "b", "c"], lambda rows: rows.withColumn("prediction", 2 * F.col("a") - 3 * F.col("b") + 5), t.withColumn("number", F.col("k")), samples=80).collect()
    assert len(got) == 180
    want = {"a": 2, "b": -3, "c": 0}
    for r in got:
        assert r.coefficient == pytest.approx(want[r.feature], abs=0.02) and r.score > 0.999
        assert r.nth == {"b": 1, "a": 2, "c": 3}[r.feature]
    rows = {r.k: r for r in t.collect()}
    assert all(r.prediction == pytest.approx(2 * rows[r.k].a - 3 * rows[r.k].b + 5) for r in got)


def test_water_bridges_need_a_water_near_both(spark):
    place = lambda rows: spark.createDataFrame(rows, "vec_id long, x double, y double, z double")
    ligands, waters = place([(1, 0.0, 0.0, 0.0), (2, 20.0, 0.0, 0.0)]), place([(7, 4.0, 0.0, 0.0), (8, 3.0, 3.0, 0.0), (9, 40.0, 0.0, 0.0)])
    receptors = place([(3, 8.0, 0.0, 0.0), (4, 9.1, 0.0, 0.0), (5, 0.5, 0.0, 0.0), (6, 24.0, 0.0, 0.0)])
    got = {(r.ligand, r.receptor) for r in docking.water_bridges(ligands, waters, receptors, 4.5).collect()}
    assert got == {(1, 3), (1, 5)}  # 4 is too far from the water, 6 is near a ligand but has none
    assert docking.water_bridges(ligands, waters.limit(0), receptors, 4.5).count() == 0


@pytest.mark.parametrize("atoms", [20_000, 2])
def test_near_pairs_are_all_pairs(spark, monkeypatch, atoms):
    monkeypatch.setattr(docking, "ATOMS", atoms)
    rows = [(i, i * 7 % 11 - 5.0, i * 5 % 7 * 1.5, -(i % 3) * 2.0) for i in range(60)]
    t = spark.createDataFrame(rows, "i int, x double, y double, z double")
    got = sorted((r.l.i, r.r.i) for r in docking.near_pairs(t, t, 3.0).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if math.dist(a[1:], b[1:]) <= 3)


def test_stored_lookups_are_joined_where_they_lie(spark):
    index = spark.createDataFrame([("name", f"k{i % 40}", i) for i in range(400)], "kind string, key string, id long")
    t = catalogue.stored_lookups(index, 4)
    asked = spark.createDataFrame([("k3",), ("k3",), ("k39",), ("none",)], "key string")
    found = catalogue.looked_up(t, asked.hint("shuffle_merge"))
    assert sorted((r.key, r.id) for r in found.collect()) == sorted((f"k{i % 40}", i) for i in range(400) if i % 40 in (3, 39))
    plan = found._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    side = [x for x in initial.split("\n") if "Exchange" in x]
    assert len(side) == 1 and "Bucketed: true" in initial  # the asked keys move, the index does not
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan says which buckets are read
    one = t.where("key = 'k3'")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in one


def test_keys_are_resolved_by_name_brand_and_substring(spark):
    texts = spark.createDataFrame([(3, "holy basil", 0), (2, "basil leaf", 0), (9, "basil", 1), (1, "neem", 0), (4, "tulsi", 1), (5, "tulsi", 0)], "p_partkey long, text string, step long")
    asked = spark.createDataFrame([("basil",), ("asil",), ("a",), ("neem",), ("tulsi",), ("holy basil x",), ("",), ("il le",)], "asked string")
    got = {r.asked: (r.p_partkey, r.step) for r in catalogue.resolved(asked, texts).collect()}
    assert got == {"basil": (9, 1), "asil": (2, 2), "a": (2, 2), "neem": (1, 0), "tulsi": (5, 0), "holy basil x": (None, None), "": (None, None), "il le": (2, 2)}


def test_any_scorer_is_explained_and_rows_it_fails_on_are_left_out(spark):
    t = spark.createDataFrame([(i, float(i % 7), float(i * i % 11)) for i in range(40)], "k int, a double, b double")
    score = lambda rows: rows.withColumn("prediction", F.when(F.col("k") != 3, F.when(F.col("k") == 5, float("nan")).otherwise(2 * F.col("a") * F.col("b"))))
    got = attribution.explained(t.where("k < 8"), t.where("k <> 3 AND k <> 5"), ["k"], {"a": 0.7, "b": 0.3}, score).collect()
    assert {r.k for r in got} == {0, 1, 2, 4, 6, 7} and len(got) == 12
    rows = [r for r in t.collect() if r.k not in (3, 5)]
    mean = {c: sum(r[c] for r in rows) / len(rows) for c in "ab"}
    base = sum(2 * r.a * r.b for r in rows) / len(rows)
    own = {r.k: r for r in rows}
    for r in got:
        x = own[r.k]
        assert r.base == pytest.approx(base) and r.prediction == pytest.approx(2 * x.a * x.b)
        other = x.b if r.feature == "a" else x.a
        assert r.c2 == pytest.approx(2 * x.a * x.b - 2 * mean[r.feature] * other) and r.c3 == pytest.approx((0.7 if r.feature == "a" else 0.3) * x[r.feature])
    for k in own:
        if k < 8:
            assert sum(abs(r.c1) for r in got if r.k == k) == pytest.approx(abs(own[k].a * own[k].b * 2 - base), abs=1e-4)


def test_a_fitted_model_is_occluded_without_a_join(spark):
    """Each row's own prediction goes with its replaced ones; a row with a NaN is left out, and the array gives what the columns give."""
    rows = [(i, float(i % 3), float(i * i % 7), float(i)) for i in range(12)]
    t = spark.createDataFrame(rows, "k int, a double, b double, y double")
    names = ["a", "b"]
    assemble = VectorAssembler(inputCols=names, outputCol="x")
    model = LinearRegression(featuresCol="x", labelCol="y").fit(assemble.transform(t))
    given = t.unionByName(spark.createDataFrame([(99, float("nan"), 1.0, 0.0)], t.schema))
    told = attribution.occluded(given, names, attribution.by_values(model), ["k"], background=t)
    plan = told._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan
    columns = attribution.occluded(t, names, lambda r: model.transform(assemble.transform(r)), ["k"])
    want = {(r.k, r.feature): r.change for r in columns.collect()}
    got = {(r.k, r.feature): r.change for r in told.collect()}
    assert set(got) == set(want) == {(k, c) for k in range(12) for c in names}
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    middle, slopes = {c: sum(r[i] for r in rows) / 12 for i, c in ((1, "a"), (2, "b"))}, dict(zip(names, model.coefficients, strict=True))
    assert all(got[r[0], c] == pytest.approx(slopes[c] * (r[i] - middle[c])) for r in rows for i, c in ((1, "a"), (2, "b")))


def test_matrices_are_occluded_as_columns_are(spark):
    """One row a line until it is scored; nulls, NaN and an input without a mean as in the general way."""
    rows = [(i, float(i % 3), float(i * i % 7), float(i)) for i in range(12)]
    t = spark.createDataFrame(rows, "k int, a double, b double, y double")
    names = ["a", "b"]
    model = LinearRegression(featuresCol="x", labelCol="y").fit(VectorAssembler(inputCols=names, outputCol="x").transform(t))
    given = t.unionByName(spark.createDataFrame([(99, float("nan"), 1.0, 0.0), (98, None, 1.0, 0.0)], t.schema))
    for background in (t, None):  # without one the mean of a is NaN
        want = {(r.k, r.feature): r.change for r in attribution.occluded(given, names, attribution.by_values(model), ["k"], background).collect()}
        told = attribution.occluded_numbers(given, names, attribution.linear(model), ["k"], background)
        got = {(r.k, r.feature): r.change for r in told.collect()}
        assert set(got) == set(want) and len(got) == (24 if background else 12)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("MapInArrow")


def test_the_matrix_of_occluded_lines_is_made_once(spark, monkeypatch):
    made, real = [], models.matrix
    count = lambda *a: made.append(a) or real(*a)
    monkeypatch.setattr(models, "matrix", count)
    monkeypatch.setattr(attribution, "matrix", count)
    got = registry.queries()["f2_model_occlusion"](spark, D).groupBy("feature").count().collect()
    assert len(made) == 1 and {r["feature"]: r["count"] for r in got} == dict.fromkeys(models.INPUTS, 6000)


def test_surrogates_by_matrices_are_those_by_rows(spark, monkeypatch):
    """The same hashes, background rows and fits, in batches that cut anywhere; a numbering with a gap, and a constant input."""
    monkeypatch.setattr(attribution, "ROWS_AT_ONCE", 3)
    monkeypatch.setattr(attribution, "ROWS_A_TASK", 5)
    rows = [(i, float(i % 5), float(i * i % 7), 0.5) for i in range(14)]
    t = spark.createDataFrame(rows, "k long, a double, b double, c double")
    names = ["a", "b", "c"]
    model = LinearRegression(featuresCol="x", labelCol="a").fit(VectorAssembler(inputCols=["b", "c", "a"], outputCol="x").transform(t))
    background = t.where("k <> 3").withColumn("number", F.col("k"))
    key = lambda r: (r.k, r.nth)
    for samples in (4, 30):
        want = {key(r): r for r in attribution.surrogate(t, "k", names, attribution.by_values(model), background, samples, 2).collect()}
        told = attribution.surrogate_numbers(t, "k", names, attribution.linear(model), background, samples, 2)
        got = {key(r): r for r in told.collect()}
        assert set(got) == set(want) and len(got) == 28
        for at, r in got.items():
            w = want[at]
            assert r.feature == w.feature and [r.coefficient, r.intercept, r.score, r.prediction] == pytest.approx([w.coefficient, w.intercept, w.score, w.prediction], abs=1e-9)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan  # a point is no row


def test_the_surrogate_of_a_linear_model_makes_no_rows_of_points(spark, monkeypatch):
    monkeypatch.setattr(attribution, "surrogate", lambda *_: pytest.fail("points as rows"))
    assert registry.queries()["f5_model_surrogate"](spark, D).count() == 10 * spark.read.parquet(f"{D}/part.parquet").count()


def test_points_of_a_surrogate_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(attribution, "ROWS_A_TASK", 2)
    t = spark.createDataFrame([(i, float(i), float(i * i % 5)) for i in range(8)], "k long, a double, b double")
    told = attribution.surrogate(t, "k", ["a", "b"], lambda r: r.withColumn("prediction", F.col("a") - F.col("b")), t.withColumn("number", F.col("k")))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the rows, before they become points
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Generate explode") < plan.index("Exchange hashpartitioning")


def test_folds_are_told_by_models_that_did_not_see_them(spark):
    """Whatever the order in which fits and folds end: each row's z is its own fold's, and rows come with what a second model needs."""
    t = spark.createDataFrame([(i, i % 5, float(i % 5), float(i % 2)) for i in range(50)], "l_orderkey long, fold int, y double, active double")
    x = VectorAssembler(inputCols=["y"], outputCol="x").transform(t)
    base = LinearRegression(featuresCol="x", labelCol="y", regParam=0.1)
    z = models.out_of_fold(x, {"one": base, "two": base.copy()}, F.col("prediction"))
    assert "x" not in z.columns
    got = {r.l_orderkey: (r.y, list(r.z)) for r in z.collect()}
    assert set(got) == set(range(50))
    for k in range(5):
        want = {r.l_orderkey: r.prediction for r in base.fit(x.where(F.col("fold") != k)).transform(x.where(F.col("fold") == k)).collect()}
        assert all(got[i] == (float(i % 5), pytest.approx([v, v])) for i, v in want.items())
