"""Feature matrices, splits, models and metrics over `lineitem` joined with `part`.

Where a prediction is needed but no fit, it is quantity times retail price; fits regress the extended price on the fused matrix.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.fold_models import Trees, cut_rows, described, held_out
from ledgerline.functions.neighbour_model import NeighbourRegressor
from ledgerline.functions.running import average_ranks, exact_quantile, running
from ledgerline.functions.scan import greatest_likeness
from ledgerline.plans.structures import _CLASS, _FLAGS, _QSAR, flags, qsar, structures
from ledgerline.registry import query
from ledgerline.sources.files import scratch, written
from ledgerline.sources.tables import read

log = logging.getLogger(__name__)
_P = "p AS (SELECT l_orderkey, l_extendedprice AS y, l_quantity * p_retailprice AS f FROM lineitem JOIN part ON l_partkey = p_partkey)"


def predictions(spark, d):
    t = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return t.select("l_orderkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("f"))


@query("e3_standardise", "SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity) + 1e-8, 6) AS scale, round(quantile_cont(l_quantity, 0.5), 6) AS median FROM lineitem")
def standardise(spark, d):
    """Mean, spread and exact median of a column, each one row."""
    t = read(spark, d, "lineitem").select("l_quantity")
    q = F.col("l_quantity")
    sums = t.agg(F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q) + 1e-8, 6).alias("scale"))
    return sums.crossJoin(F.broadcast(exact_quantile(t, "l_quantity", 0.5))).select("mean", "scale", F.round("quantile", 6).alias("median"))  # one row


@query("e8_group_folds", "SELECT CAST('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8) AS BIGINT) % 5 AS fold, count(*)::BIGINT AS n, count(DISTINCT l_orderkey)::BIGINT AS groups FROM lineitem GROUP BY 1")
def group_folds(spark, d):
    fold = (F.conv(F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 8), 16, 10).cast("long") % 5).alias("fold")
    per = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    return per.groupBy(fold).agg(F.sum("k").alias("n"), F.count("*").alias("groups"))


@query("e8_stratified_folds", "WITH h AS (SELECT event_id, event_type, md5(event_id || '_f') AS h FROM events), r AS (SELECT *, (row_number() OVER (PARTITION BY event_type, substr(h, 1, 2) ORDER BY h, event_id) - 1) % 5 AS fold FROM h) SELECT event_type, fold::BIGINT AS fold, count(*)::BIGINT AS n FROM r GROUP BY 1, 2")
def stratified_folds(spark, d):
    """Folds that each have their share of every label: places within (label, hash prefix), so no window holds a whole label."""
    t = read(spark, d, "events").select("event_id", "event_type", F.md5(F.concat(F.col("event_id").cast("string"), F.lit("_f"))).alias("h"))
    place = F.row_number().over(Window.partitionBy("event_type", F.substring("h", 1, 2)).orderBy("h", "event_id"))
    return t.select("event_type", ((place - 1) % 5).cast("long").alias("fold")).groupBy("event_type", "fold").agg(F.count("*").alias("n"))


@query("e8_plain_folds", "SELECT CAST('0x' || substr(md5(event_id || '_f'), 1, 8) AS BIGINT) % 5 AS fold, count(*)::BIGINT AS n FROM events GROUP BY 1")
def plain_folds(spark, d):
    h = F.conv(F.substring(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("_f"))), 1, 8), 16, 10).cast("long")
    return read(spark, d, "events").groupBy((h % 5).alias("fold")).agg(F.count("*").alias("n"))


#: Columns of the fused matrix in their order, by group.
DOCKING = ("affinity", "efficiency", "intermolecular", "torsional", "desolvation", "hbonds", "hydrophobic", "vdw", "electrostatic", "occupancy")
QSAR = ("mw", "logp", "hbd", "hba", "tpsa", "rot", "heavy", "rings", "arom", "csp3", "aliphatic", "het", "charge", "radicals", "bertz", "balaban", "bcut", "qed")
CLASS = ("flavonoid", "alkaloid", "terpenoid", "phenolic", "saponin", "tannin", "privileged", "use_score", "a", "b", "c")
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_DOCKED = {"affinity": "-4 - 80 * l_discount", "efficiency": "(-4 - 80 * l_discount) / coalesce(heavy, 20)", "intermolecular": "0.85 * (-4 - 80 * l_discount)", "torsional": "0.5", "desolvation": "0", "hbonds": "2", "hydrophobic": "5", "vdw": "10", "electrostatic": "0", "occupancy": "0.6"}


def fused(lines: DataFrame, parts: DataFrame, use_docking: bool = True, use_qsar: bool = True, use_class: bool = True, normalise: bool = False, keep: tuple[str, ...] = LINE) -> DataFrame:
    """Docking, structure and class columns of each line in their fixed order, missing ones 0; a group that is switched off is 0 as well.

    lines(keep, l_partkey, affinity and any docking column by its name), parts(p_partkey, p_name, s). normalise: each column less its mean
    over its spread.
    """
    # a part's columns are made and mended once a part: what is left to each line is short enough that the JVM compiles it
    own = lambda name: finite(F.coalesce(F.col(name).cast("double"), F.lit(0.0))).alias(name)
    # a small file of many parts is one task unless it is dealt out
    parts = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    described = qsar(parts.select("p_partkey", "s")).withColumn("radicals", F.lit(0)).drop("s").join(flags(parts), "p_partkey")
    described = described.select("p_partkey", *map(own, (*QSAR, *CLASS)))
    t = lines.join(described, F.col("p_partkey") == F.col("l_partkey"), "left")
    given = lambda name, default: F.coalesce(F.col(name), default) if name in lines.columns else default
    affinity = F.coalesce("affinity", F.lit(-7.0))
    docking = {
        "affinity": affinity,
        "efficiency": given("efficiency", affinity / F.coalesce("heavy", F.lit(20))),
        "intermolecular": given("intermolecular", 0.85 * affinity),
        "torsional": given("torsional", F.lit(0.5)),
        "desolvation": given("desolvation", F.lit(0.0)),
        "hbonds": given("hbonds", F.lit(2.0)),
        "hydrophobic": given("hydrophobic", F.lit(5.0)),
        "vdw": given("vdw", F.lit(10.0)),
        "electrostatic": given("electrostatic", F.lit(0.0)),
        "occupancy": given("occupancy", F.lit(0.6)),
    }
    of_part = lambda names, on: [(n, F.coalesce(F.col(n), F.lit(0.0)), on) for n in names]
    columns = [(n, docking[n], use_docking) for n in DOCKING] + of_part(QSAR, use_qsar) + of_part(CLASS, use_class)
    out = t.select(*keep, *((c.cast("double") if on else F.lit(0.0)).alias(n) for n, c, on in columns))
    if not normalise:
        return out
    stats = out.agg(*(f(n).alias(f"{k}_{n}") for n, *_ in columns for k, f in (("mean", F.avg), ("spread", F.stddev_pop))))
    return out.crossJoin(F.broadcast(stats)).select(*keep, *(((F.col(n) - F.col(f"mean_{n}")) / (F.col(f"spread_{n}") + 1e-8)).alias(n) for n, *_ in columns))  # one row


_MATRIX = [f"round(({x})::DOUBLE, 6) AS {n}" for n, x in _DOCKED.items()] + [f"round(coalesce({'0' if n == 'radicals' else n}, 0)::DOUBLE, 5) AS {n}" for n in QSAR] + [f"coalesce({n}, 0)::DOUBLE AS {n}" for n in CLASS]


@query("e1_fused_features", f"WITH {_QSAR}, cls AS (WITH {_CLASS} {_FLAGS}) SELECT {', '.join((*LINE, *_MATRIX))} FROM lineitem LEFT JOIN qsar ON qsar.p_partkey = l_partkey LEFT JOIN cls ON cls.p_partkey = l_partkey")
def fused_features(spark, d):
    lines = read(spark, d, "lineitem").select(*LINE, (-4 - 80 * F.col("l_discount")).alias("affinity"))
    t = fused(lines, structures(spark, d).select("p_partkey", "p_name", "s"))
    return t.select(*LINE, *(F.round(c, 6).alias(c) for c in DOCKING), *(F.round(c, 5).alias(c) for c in QSAR), *CLASS)


@query("e1_structure_only", "SELECT count(*)::BIGINT AS n, 0.0::DOUBLE AS docking, 0.0::DOUBLE AS classes FROM lineitem")
def structure_only(spark, d):
    """The matrix with two of its groups switched off: their columns are 0 in every row."""
    lines = read(spark, d, "lineitem").select(*LINE, (-4 - 80 * F.col("l_discount")).alias("affinity"))
    t = fused(lines, structures(spark, d).select("p_partkey", "p_name", "s"), use_docking=False, use_class=False)
    most = lambda names: F.greatest(*(F.max(F.abs(c)) for c in names))
    return t.agg(F.count("*").alias("n"), most(DOCKING).alias("docking"), most(CLASS).alias("classes"))


def finite(x: Column) -> Column:
    """NaN becomes 0, the infinities 10 and -10."""
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), 10.0).when(x == float("-inf"), -10.0).otherwise(x)


@query("e2_finite_values", "SELECT event_id, CASE WHEN isnan(value) THEN 0 WHEN value = 'inf'::DOUBLE THEN 10 WHEN value = '-inf'::DOUBLE THEN -10 ELSE value END::DOUBLE AS x FROM events")
def finite_values(spark, d):
    return read(spark, d, "events").select("event_id", finite(F.col("value").cast("double")).alias("x"))


@query("e4_class_label", "SELECT doc_id, coalesce(quality, (n_chars / 300.0 >= 6.5)::INT)::BIGINT AS label FROM documents LEFT JOIN labels USING (doc_id)")
def class_label(spark, d):
    """A given label wins over the one that follows from the value."""
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", (F.col("n_chars") / 300 >= 6.5).cast("int")).cast("long").alias("label"))


def held_groups(groups: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """A share of the distinct groups, at least one, by the order of a seeded hash.

    The hash of the last group taken is found from counts per hash prefix, then within that prefix; no sort holds all groups.
    """
    hashed = groups.select(key).distinct().withColumn("h_", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).withColumn("prefix_", F.substring("h_", 1, 3))
    counts = sorted((r["prefix_"], r["n_"]) for r in hashed.groupBy("prefix_").agg(F.count("*").alias("n_")).collect())  # at most 4096 rows
    left = max(1, int(sum(n for _, n in counts) * share))
    edge = ""
    for edge, n in counts:  # noqa: B007
        if left <= n:
            break
        left -= n
    whole = hashed.where(F.col("prefix_") < edge)
    part = hashed.where(F.col("prefix_") == edge).orderBy("h_", key).limit(left)  # a 4096th of the groups
    return whole.unionByName(part).select(key)


@query("e5_group_holdout", "WITH g AS (SELECT DISTINCT l_partkey FROM lineitem), t AS (SELECT l_partkey FROM g ORDER BY md5(l_partkey || 's1'), l_partkey LIMIT (SELECT greatest(1, floor(count(*) * 0.2))::BIGINT FROM g)) SELECT l_partkey IN (SELECT * FROM t) AS test, count(*)::BIGINT AS n, count(DISTINCT l_partkey)::BIGINT AS groups FROM lineitem GROUP BY 1")
def group_holdout(spark, d, least: tuple[int, int] = (5, 10)):
    """A fifth of the groups is held out; if that leaves fewer than `least` test or training rows, whole clusters are instead."""
    t = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    test = held_groups(t, "l_partkey", 0.2, "s1").withColumn("test", F.lit(True))
    split = written(t.join(test, "l_partkey", "left").groupBy(F.coalesce("test", F.lit(False)).alias("test")).agg(F.sum("n").alias("n"), F.count("*").alias("groups")))
    rows = {r["test"]: r["n"] for r in split.collect()}  # two rows
    if rows.get(True, 0) < least[0] or rows.get(False, 0) < least[1]:
        return cluster_holdout(spark, d).groupBy("test").agg(F.sum("n").alias("n"), F.count("*").alias("groups"))
    return split


@query("e7_random_split", "SELECT CAST('0x' || substr(md5(event_id || '_7'), 1, 8) AS BIGINT) % 5 = 0 AS test, count(*)::BIGINT AS n FROM events GROUP BY 1")
def random_split(spark, d):
    h = F.conv(F.substring(F.md5(F.concat(F.col("event_id").cast("string"), F.lit("_7"))), 1, 8), 16, 10).cast("long")
    return read(spark, d, "events").groupBy((h % 5 == 0).alias("test")).agg(F.count("*").alias("n"))


_RANKS = "SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS rf FROM p"


@query("e10_regression_metrics", f"WITH {_P}, r AS ({_RANKS}) SELECT round(sqrt(avg((y - f) ^ 2)), 3) AS rmse, round(avg(abs(y - f)), 3) AS mae, round(corr(y, f), 6) AS pearson, round(corr(ry, rf), 6) AS spearman, round(1 - avg((y - f) ^ 2) / var_pop(y), 6) AS r2 FROM r")
def regression_metrics(spark, d):
    e = F.col("y") - F.col("f")
    t = average_ranks(average_ranks(written(predictions(spark, d)), "y", "ry"), "f", "rf")
    return t.agg(F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"), F.round(F.avg(F.abs(e)), 3).alias("mae"), F.round(F.corr("y", "f"), 6).alias("pearson"), F.round(F.corr("ry", "rf"), 6).alias("spearman"), F.round(1 - F.avg(e * e) / F.var_pop("y"), 6).alias("r2"))


_CLS = "cl AS (SELECT l_extendedprice >= 30000 AS y, l_quantity * p_retailprice AS f, l_quantity >= 25 AS g FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("e11_classification_metrics", f"""WITH {_CLS}, c AS (SELECT count(*) FILTER (y AND g)::DOUBLE AS tp, count(*) FILTER (y AND NOT g)::DOUBLE AS fn, count(*) FILTER (NOT y AND g)::DOUBLE AS fp, count(*) FILTER (NOT y AND NOT g)::DOUBLE AS tn FROM cl),
    k AS (SELECT f, count(*) FILTER (y) AS pos, count(*) AS n FROM cl GROUP BY 1), u AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM k WINDOW w AS (ORDER BY f)),
    v AS (SELECT sum(pos * (cn - cp - (n - pos) / 2.0)) AS wins, sum(pos * (tp + fn - cp + pos) / (tp + fn + fp + tn - cn + n)) AS ap FROM u, c)
    SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(wins / ((tp + fn) * (tn + fp)), 6) AS roc_auc, round(ap / (tp + fn), 6) AS pr_auc FROM c, v""")
def classification_metrics(spark, d):
    """Counts in one pass; both areas from cumulative counts per distinct score. With one class only the areas are 0.5 and its rate."""
    t = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = t.select((F.col("l_extendedprice") >= 30000).alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("f"), (F.col("l_quantity") >= 25).alias("g"))
    y, g = F.col("y"), F.col("g")
    n = lambda c: F.count_if(c).cast("double")
    c = t.agg(n(y & g).alias("tp"), n(y & ~g).alias("fn"), n(~y & g).alias("fp"), n(~y & ~g).alias("tn"))  # one row
    k = running(t.groupBy("f").agg(F.count_if(y).alias("pos"), F.count("*").alias("n")), "f", ("pos", "n")).crossJoin(F.broadcast(c))
    wins = F.sum(F.col("pos") * (F.col("up_to_n") - F.col("up_to_pos") - (F.col("n") - F.col("pos")) / 2))
    ap = F.sum(F.expr("pos * (tp + fn - up_to_pos + pos) / (tp + fn + fp + tn - up_to_n + n)"))
    k = k.groupBy("tp", "fn", "fp", "tn").agg(wins.alias("wins"), ap.alias("ap"))
    r = lambda x, name: F.round(F.expr(x), 6).alias(name)
    return k.select(r("(tp + tn) / (tp + tn + fp + fn)", "accuracy"), r("(tp / (tp + fn) + tn / (tn + fp)) / 2", "balanced"), r("2 * tp / (2 * tp + fp + fn)", "f1"), r("coalesce(wins / nullif((tp + fn) * (tn + fp), 0), 0.5)", "roc_auc"), r("CASE WHEN (tp + fn) * (tn + fp) = 0 THEN (tp + fn) / (tp + fn + fp + tn) ELSE ap / (tp + fn) END", "pr_auc"))


@query("e19_affinity_units", "WITH k AS (SELECT event_id, least(11, greatest(3, value / 10)) AS pkd FROM events) SELECT event_id, round(pkd, 6) AS pkd, round(-1.3633 * pkd, 9) AS dg, round(10 ^ (9 - pkd), 3) AS kd FROM k")
def affinity_units(spark, d):
    pkd = F.least(F.lit(11.0), F.greatest(F.lit(3.0), F.col("value") / 10))
    return read(spark, d, "events").select("event_id", F.round(pkd, 6).alias("pkd"), F.round(-1.3633 * pkd, 9).alias("dg"), F.round(F.pow(F.lit(10.0), 9 - pkd), 3).alias("kd"))


@query("e22_domain_ranking", "SELECT event_id, round(value / 10 * CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.8 WHEN 'signup' THEN 0.5 ELSE 0.1 END, 6) AS score FROM events ORDER BY score DESC, event_id LIMIT 50")
def domain_ranking(spark, d):
    kind = F.col("event_type")
    w = F.when(kind == "view", 1.0).when(kind == "click", 0.8).when(kind == "signup", 0.5).otherwise(0.1)
    return read(spark, d, "events").select("event_id", F.round(F.col("value") / 10 * w, 6).alias("score")).orderBy(F.desc("score"), "event_id").limit(50)


@query("e24_split_leaks", """WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM benchmark), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM documents),
    a AS (SELECT item_id, count(*) AS a FROM q GROUP BY 1), b AS (SELECT doc_id, count(*) AS b FROM t GROUP BY 1), i AS (SELECT item_id, doc_id, count(*) AS i FROM q JOIN t USING (w) GROUP BY 1, 2)
    SELECT item_id, round(max(i::DOUBLE / (a + b - i)), 6) AS most, count(*) FILTER (i > 0.9 * (a + b - i))::BIGINT AS leaks FROM i JOIN a USING (item_id) JOIN b USING (doc_id) GROUP BY 1""")
def split_leaks(spark, d):
    """The greatest Jaccard similarity of each held-out text to any document, and pairs above 0.9."""
    words = lambda name, key: read(spark, d, name).select(key, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0)).alias("terms"))
    found = greatest_likeness(words("documents", "doc_id"), words("benchmark", "item_id"), (9, 10))
    return found.select("item_id", F.round("most", 6).alias("most"), F.col("n").alias("leaks"))


# ---- fits


INPUTS = [*DOCKING, *QSAR, *CLASS]


def matrix(spark, d, *keep: str) -> DataFrame:
    """The fused matrix of all lines, with any of their columns."""
    lines = read(spark, d, "lineitem").withColumn("affinity", -4 - 80 * F.col("l_discount"))
    return fused(lines, structures(spark, d).select("p_partkey", "p_name", "s"), keep=keep)


def training(spark, d) -> DataFrame:
    """Rows with the vector x of the fused matrix, the target y, a class and the fold of their order."""
    t = matrix(spark, d, *LINE, "l_extendedprice").withColumnRenamed("l_extendedprice", "y")
    t = t.withColumns({"active": (F.col("y") >= 30000).cast("double"), "fold": F.pmod(F.xxhash64("l_orderkey"), F.lit(5))})
    # fits read their rows many times: the matrix is made once
    return by_rows(assembled(t, INPUTS).select("l_orderkey", "x", "y", "active", "fold"))


def assembled(t: DataFrame, inputs: Iterable[str]) -> DataFrame:
    """t with the vector x of its columns; rows in which one of them is null or NaN are left out."""
    whole = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(c), inputs, F.lit(True))
    return t.where(whole).withColumn("x", array_to_vector(F.array(*inputs)))


#: Rows of one file of a fit's table, and of one task that reads it: some 80 MB with 39 inputs, however small the file is.
ROWS_A_FILE = 250_000


def by_rows(t: DataFrame) -> DataFrame:
    """t written once and read again in tasks of at most ROWS_A_FILE rows.

    Columns of few different values are small in files and large in memory, and fits keep what a task reads: tasks dealt by bytes would
    grow. The table is read by a session of its own, where the cost of a file is a task's size, so that each file is a task.
    """
    spark = t.sparkSession
    apart = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            apart.conf.set(name, value)
    apart.conf.set("spark.sql.files.openCostInBytes", apart.conf.get("spark.sql.files.maxPartitionBytes"))
    path = scratch(spark, "table")
    t.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(path)
    return apart.read.schema(t.schema).parquet(path)


def regressors() -> dict:
    """The models that are compared; all with features x and target y."""
    both = {"featuresCol": "x", "labelCol": "y"}
    return {
        "ridge": LinearRegression(**both, regParam=1.0, elasticNetParam=0.0),
        "lasso": LinearRegression(**both, regParam=1.0, elasticNetParam=1.0),
        "elastic_net": LinearRegression(**both, regParam=1.0, elasticNetParam=0.5),
        "tree": DecisionTreeRegressor(**both, maxDepth=5, seed=7),
        "forest": RandomForestRegressor(**both, numTrees=10, maxDepth=5, seed=7),
        "boosted": GBTRegressor(**both, maxIter=5, maxDepth=3, seed=7),
        "neighbours": NeighbourRegressor(**both, k=5),
    }


def scored(t: DataFrame, *names: str | Column) -> DataFrame:
    e = F.col("y") - F.col("prediction")
    return t.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.var_pop("y")).alias("r2")).select(*names, "n", "rmse", "r2")


@query("e6_cluster_holdout")
def cluster_holdout(spark, d):
    """Whole clusters of the feature space are held out: a tenth as many as rows, 5 to 20."""
    x = training(spark, d)
    model = KMeans(k=max(5, min(20, x.count() // 10)), featuresCol="x", predictionCol="cluster", seed=7, maxIter=10).fit(x)
    t = model.transform(x).groupBy("cluster").agg(F.count("*").alias("n"))
    test = held_groups(t, "cluster", 0.2, "s1").withColumn("test", F.lit(True))
    return t.join(test, "cluster", "left").select("cluster", "n", F.coalesce("test", F.lit(False)).alias("test"))


METRICS = "name string, n long, rmse double, r2 double, error string"
#: Fits that run at the same time; each keeps its own tasks, which the scheduler interleaves.
AT_ONCE = 4


def side_by_side(spark, jobs: dict[str, Callable[[], DataFrame]], at_once: int = AT_ONCE) -> DataFrame:
    """The one row of metrics of each job, run from a bounded pool of threads: name, n, rmse, r2, error.

    A fit that fails (as on a fold without rows) is a row with its error and no metrics.
    """

    def run(item: tuple[str, Callable[[], DataFrame]]) -> tuple:
        name, job = item
        try:
            r = job().first()
            return name, r["n"], r["rmse"], r["r2"], None if r["n"] else "no rows"
        except (PySparkException, Py4JJavaError) as e:
            return _failed(name, e)

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(run), jobs.items()))
    return spark.createDataFrame(rows, METRICS)


def _failed(name: str, e: Exception) -> tuple:
    log.warning("%s failed: %s", name, e)
    return name, 0, None, None, re.sub(r"\s+", " ", str(e))[:200]


def scaled(model) -> Pipeline:
    """The model behind a scaler of its own, fitted on the rows that the model is fitted on."""
    return Pipeline(stages=[StandardScaler(inputCol="x", outputCol="scaled", withMean=True), model.setFeaturesCol("scaled")])


def fold_moments(x: DataFrame, folds: int) -> np.ndarray:
    """Of each fold the sums of the products of (1, inputs, target) with each other.

    One pass; a task gives one square of numbers a fold. Columns are shifted by the first row's values: sums of constant ones are exactly 0.
    """
    t = x.select("fold", vector_to_array("x").alias("x"), F.col("y").cast("double").alias("y")).where("y is not null")
    first = t.first()
    if first is None:
        return np.zeros((folds, 2, 2))
    shift, n = np.array([0.0, *first["x"], first["y"]]), len(first["x"]) + 2

    def add(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums = np.zeros((folds, n, n))
        for b in batches:
            fold, rows = b.column("fold").to_numpy(), np.ones((b.num_rows, n))
            rows[:, 1:-1], rows[:, -1] = b.column("x").flatten().to_numpy().reshape(-1, n - 2), b.column("y").to_numpy()
            rows -= shift
            for k in range(folds):
                own = rows[fold == k]
                sums[k] += own.T @ own
        yield pa.RecordBatch.from_pydict({"fold": pa.array(range(folds), pa.int64()), "sums": pa.array(list(sums.reshape(folds, -1)), pa.list_(pa.float64()))})

    def total(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, n * n).sum(0)
        return pa.table({"fold": table.column("fold").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    kind = "fold long, sums array<double>"
    got = {r["fold"]: r["sums"] for r in t.mapInArrow(add, kind).groupBy("fold").applyInArrow(total, kind).collect()}  # a square a fold
    return np.array([got[k] for k in range(folds)]).reshape(folds, n, n)


def metrics_by_moments(fit: np.ndarray, held: np.ndarray, penalty: float, lasso: float) -> tuple:
    """n, rmse, r2 and error on held rows of a linear model of others, both given by their sums of products.

    The model is that of LinearRegression with regParam and elasticNetParam, which weighs standardised coefficients: a scaler before it changes nothing,
    and the sums of products of the rows are all that it needs, as do its errors.
    """
    n, seen = held[0, 0], fit[0, 0]
    if not n or not seen:
        return 0, None, None, "no rows"
    mean, cross = fit[0, 1:] / seen, fit[1:, 1:] / seen
    about = cross - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(about), 0.0))
    own, there = spread[-1], spread[:-1] > 0
    slopes = np.zeros(len(spread) - 1)
    if own and there.any():
        scale = spread[:-1][there]
        like, toward = about[:-1, :-1][np.ix_(there, there)] / np.outer(scale, scale), about[:-1, -1][there] / (scale * own)
        slopes[there] = shrunk(like, toward, penalty / own, lasso) * own / scale
    error = np.array([slopes @ mean[:-1] - mean[-1], *-slopes, 1.0])
    square, spread_held = error @ held @ error / n, held[-1, -1] / n - (held[0, -1] / n) ** 2
    if spread_held <= 0:
        return int(n), None, None, "the target has no spread"
    return int(n), float(np.sqrt(max(square, 0.0))), float(1 - square / spread_held), None


def shrunk(like: np.ndarray, toward: np.ndarray, penalty: float, lasso: float, sweeps: int = 10_000) -> np.ndarray:
    """The b of least b'like b / 2 - toward'b + penalty (lasso |b| + (1 - lasso) b'b / 2), one coefficient after another where lasso is not 0."""
    if not lasso:
        return np.linalg.solve(like + penalty * np.eye(len(like)), toward)
    b = np.zeros(len(like))
    for _ in range(sweeps):
        before = b.copy()
        for j in range(len(b)):
            rest = toward[j] - like[j] @ b + like[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - penalty * lasso, 0.0) / (like[j, j] + penalty * (1 - lasso))
        if np.abs(b - before).max() < 1e-12:
            break
    return b


def ridge_by_moments(x: DataFrame, folds: int, penalty: float) -> DataFrame:
    """The metrics of a ridge model of the other folds' rows on each fold's, and of one of all rows on these: name, n, rmse, r2, error."""
    each = fold_moments(x, folds)
    whole = each.sum(0)
    rows = [(str(k), *metrics_by_moments(np.delete(each, k, 0).sum(0), each[k], penalty, 0.0)) for k in range(folds)] + [("all", *metrics_by_moments(whole, whole, penalty, 0.0))]
    return x.sparkSession.createDataFrame(rows, METRICS)


@query("e9_cross_validation")
def cross_validation(spark, d, model: str = "ridge", folds: int = 5):
    """Folds by order: each is predicted by a model, with a scaler, of the rest; a fold that fails is counted and left out. Mean and
    spread of the metrics, and the error of the model refitted on all rows. A ridge model is solved for every fold from one pass over the
    rows (`ridge_by_moments`); other fits run side by side."""
    x, base = training(spark, d).withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(folds))), regressors()[model]
    of_fold = lambda k: lambda: scored(scaled(regressors()[model]).fit(x.where(F.col("fold") != k)).transform(x.where(F.col("fold") == k)))
    if isinstance(base, LinearRegression) and base.getElasticNetParam() == 0:
        each = ridge_by_moments(x, folds, base.getRegParam())
    else:
        each = side_by_side(spark, {str(k): of_fold(k) for k in range(folds)} | {"all": lambda: scored(scaled(regressors()[model]).fit(x).transform(x))})
    part = lambda c: F.when(F.col("name") != "all", F.when(F.col("error").isNull(), F.col(c)))
    failed = F.count_if((F.col("name") != "all") & F.col("error").isNotNull()).alias("failed")
    return each.agg(F.count(part("n")).alias("folds"), failed, F.sum(part("n")).alias("n"), F.avg(part("rmse")).alias("rmse"), F.stddev_pop(part("rmse")).alias("rmse_spread"), F.avg(part("r2")).alias("r2"), F.stddev_pop(part("r2")).alias("r2_spread"), F.max(F.when(F.col("name") == "all", F.col("rmse"))).alias("refit_rmse"))


@query("e12_model_benchmark")
def model_benchmark(spark, d, models: dict | None = None):
    """Hold-out metrics of every regressor of a catalogue (`regressors()` unless given); one that fails is a row with its error.

    Linear models are solved from one pass over the rows, trees share theirs (`fold_models`), others are fitted side by side.
    """
    x, models = training(spark, d), models or regressors()
    job = lambda m: lambda: scored(m.fit(x.where("fold > 0")).transform(x.where("fold = 0")))
    # weighted or otherwise set models are fitted by themselves
    linear = {name: m for name, m in models.items() if isinstance(m, LinearRegression) and {p.name for p in m._paramMap} <= {"featuresCol", "labelCol", "predictionCol", "regParam", "elasticNetParam"} and m.getLabelCol() == "y"}
    shared = {name: t for name, m in models.items() if isinstance(t := described(m), Trees) and t.label == "y"}
    rows = []
    for own, told in ((linear, lambda: _linear_metrics(x, linear)), (shared, lambda: _tree_metrics(x, shared))):
        try:
            rows += told() if own else []
        except (PySparkException, Py4JJavaError) as e:
            rows += [_failed(name, e) for name in own]
    others = side_by_side(spark, {name: job(m) for name, m in models.items() if name not in linear and name not in shared})
    return others.unionByName(spark.createDataFrame(rows, METRICS)).withColumnRenamed("name", "model")


def _linear_metrics(x: DataFrame, models: dict[str, LinearRegression]) -> list[tuple]:
    each = fold_moments(x, 5)
    return [(name, *metrics_by_moments(each[1:].sum(0), each[0], m.getRegParam(), m.getElasticNetParam())) for name, m in models.items()]


def _tree_metrics(x: DataFrame, models: dict[str, Trees]) -> list[tuple]:
    cut, ranges = cut_rows(x.select("x", "y", "fold"), max(m.bins for m in models.values()))
    told = written(held_out(by_rows(cut), ranges, models, [0], ("y",)))
    rows = [(name, scored(told.withColumnRenamed(name, "prediction")).first()) for name in models]
    return [(name, r["n"], r["rmse"], r["r2"], None if r["n"] else "no rows") for name, r in rows]


@query("e13_best_model")
def best_model(spark, d):
    """The model with the greatest r2 and the one with the least error."""
    return model_benchmark(spark, d).where("error is null").agg(F.max_by("model", F.struct("r2", "model")).alias("by_r2"), F.min_by("model", F.struct("rmse", "model")).alias("by_rmse"))


@query("e15_classifiers")
def classifiers(spark, d):
    """Balanced by weight: each class has half of the total weight."""
    x = training(spark, d)
    share = x.agg(F.avg("active").alias("share"))  # one row
    x = x.crossJoin(F.broadcast(share)).withColumn("w", F.when(F.col("active") == 1, 0.5 / F.col("share")).otherwise(0.5 / (1 - F.col("share"))))
    both = {"featuresCol": "x", "labelCol": "active", "weightCol": "w"}
    models = {"logistic": LogisticRegression(**both, maxIter=20), "forest": RandomForestClassifier(**both, numTrees=10, maxDepth=4, seed=7), "boosted": GBTClassifier(**both, maxIter=5, maxDepth=3, seed=7)}
    out = None
    for name, model in models.items():
        t = model.fit(x.where("fold > 0")).transform(x.where("fold = 0"))
        p, a = F.col("prediction") == 1, F.col("active") == 1
        n = lambda c: F.count_if(c).cast("double")
        m = t.agg(F.count("*").alias("n"), n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"), n(~p & ~a).alias("tn"))
        share = lambda x, y: F.coalesce(F.expr(f"({x}) / nullif({y}, 0)"), F.lit(0.0))
        m = m.select(F.lit(name).alias("model"), "n", share("tp + tn", "n").alias("accuracy"), ((share("tp", "tp + fn") + share("tn", "tn + fp")) / 2).alias("balanced"), share("2 * tp", "2 * tp + fp + fn").alias("f1"))
        out = m if out is None else out.unionByName(m)
    return out


@query("e16_stacking")
def stacking(spark, d):
    """Out-of-fold predictions of the tree models, and of the nearest rows, are the features of a ridge model."""
    z = out_of_fold(training(spark, d), {n: regressors()[n] for n in ("tree", "forest", "boosted", "neighbours")}, F.col("prediction"))
    meta = LinearRegression(featuresCol="z", labelCol="y", regParam=1.0).fit(z.where("fold > 0"))
    return scored(meta.transform(z.where("fold = 0")))


def out_of_fold(x: DataFrame, bases: dict, field: Column) -> DataFrame:
    """x's rows with z instead of x: the base models' predictions of each row by models that did not see its fold.

    Trees and logistic models of all folds are fitted in passes that they share (`fold_models`), nearest rows of all folds are found in one search;
    of the others fits run side by side, then folds.
    """
    kept = [c for c in x.columns if c != "x"]
    shared = {name: m for name in bases if (m := described(bases[name]))}
    near = [name for name in bases if isinstance(bases[name], NeighbourRegressor)]
    others = [name for name in bases if name not in shared and name not in near]
    if shared:
        cut, ranges = cut_rows(x, max((m.bins for m in shared.values() if isinstance(m, Trees)), default=2))
        rows = held_out(by_rows(cut), ranges, shared, range(5), (*kept, *(["x"] if others or near else [])))
        rows = rows.withColumn("x", array_to_vector("x")) if others or near else rows
    else:
        rows = x
    for name in near:
        # the search sees the rows twice: they are told apart once
        told = written(rows)
        rows = bases[name].held_out(told, "fold").withColumnRenamed(bases[name].getPredictionCol(), name)
    gathered = lambda t: written(VectorAssembler(inputCols=list(bases), outputCol="z").transform(t).drop("x", *bases))
    if not others:
        return gathered(rows)
    at = [(k, name) for k in range(5) for name in others]
    fit = lambda item: bases[item[1]].copy().fit(x.where(F.col("fold") != item[0]))

    def told(k: int) -> DataFrame:
        fold = rows.where(F.col("fold") == k)
        for name in others:
            fold = models[k, name].transform(fold).withColumn(name, field).drop("prediction", "rawPrediction", "probability")
        return gathered(fold)

    threaded = inheritable_thread_target(x.sparkSession)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        models = dict(zip(at, pool.map(threaded(fit), at), strict=True))
        return reduce(DataFrame.unionByName, pool.map(threaded(told), range(5)))


@query("e16_stacked_classifier")
def stacked_classifier(spark, d):
    """The same for classes: out-of-fold probabilities of the base models are the features of a logistic model."""
    both = {"featuresCol": "x", "labelCol": "active"}
    bases = {"logistic": LogisticRegression(**both, maxIter=10), "forest": RandomForestClassifier(**both, numTrees=5, maxDepth=3, seed=7), "boosted": GBTClassifier(**both, maxIter=3, maxDepth=3, seed=7)}
    z = out_of_fold(training(spark, d), bases, vector_to_array("probability")[1])
    t = LogisticRegression(featuresCol="z", labelCol="active", maxIter=10).fit(z.where("fold > 0")).transform(z.where("fold = 0"))
    return t.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("active")).cast("double")).alias("accuracy"))


@query("e17_batch_predict")
def batch_predict(spark, d):
    """Every row of the table: one without a docking result (each order's seventh line) keeps a sentinel and an error."""
    t = matrix(spark, d, *LINE).withColumn("whole", F.col("l_linenumber") < 7)
    model = regressors()["ridge"].fit(training(spark, d))
    p = model.transform(VectorAssembler(inputCols=INPUTS, outputCol="x").transform(t))
    return p.select(*LINE, F.when(F.col("whole"), F.col("prediction")).otherwise(0.0).alias("prediction"), F.when(~F.col("whole"), "missing feature").alias("error"))


@query("e18_ensemble_uncertainty")
def ensemble_uncertainty(spark, d, names: tuple[str, ...] = ("ridge", "tree", "forest")):
    """Spread of the predictions of the models named for each held-out row, plus 0.2; of a single model it is 0.5."""
    x = training(spark, d)
    t = x.where("fold = 0")
    for name in names:
        t = regressors()[name].fit(x.where("fold > 0")).transform(t).withColumnRenamed("prediction", name)
    p = F.array(*names)
    mean = F.aggregate(p, F.lit(0.0), lambda a, b: a + b) / len(names)
    spread = F.sqrt(F.aggregate(F.transform(p, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, b: a + b) / len(names))
    return t.select("l_orderkey", mean.alias("mean"), (spread + 0.2 if len(names) > 1 else F.lit(0.5)).alias("uncertainty"))


#: What a pose's rescoring sees: three scores and eleven columns of the ligand and its contacts.
RESCORING = ("vina", "ad4", "hybrid", "mw_norm", "logp", "hbd", "hba", "rot_norm", "tpsa_norm", "heavy_norm", "arom", "hydrophobic", "hbonds", "charge")


def leaf_values(model) -> list[list[float]]:
    """The predictions of a forest's leaves, tree by tree, in the order in which leafCol numbers them (bounded by trees and their depth)."""

    def leaves(node) -> list[float]:
        if not node.getClass().getSimpleName().startswith("Internal"):
            return [float(node.prediction())]
        return leaves(node.leftChild()) + leaves(node.rightChild())

    return [leaves(tree._call_java("rootNode")) for tree in model.trees]


def by_tree(t: DataFrame, model, out: str) -> DataFrame:
    """t with an array of every tree's prediction: one pass finds the leaves of all trees, a literal table has their values."""
    table = F.array(*(F.array(*map(F.lit, own)) for own in leaf_values(model)))
    found = model.setLeafCol("leaf_").transform(t)
    return found.withColumn(out, F.zip_with(vector_to_array("leaf_"), table, lambda leaf, own: F.get(own, leaf.cast("int")))).drop("leaf_")


@query("e25_forest_rescoring")
def forest_rescoring(spark, d, trees: int = 50):
    """Affinities rescored by a forest over 14 inputs, kept within -12 and -4; the confidence falls with the variance over the trees.

    The second score is 0.9 of the first plus its ligand's share, the measured affinity stands in as -4 - 100 * tax.
    """
    c = F.col
    t = matrix(spark, d, *LINE, "l_tax").withColumn("ad4", 0.9 * c("affinity") - 0.05 * c("logp"))
    inputs = {"vina": c("affinity"), "ad4": c("ad4"), "hybrid": 0.6 * c("affinity") + 0.4 * c("ad4"), "mw_norm": c("mw") / 500, "rot_norm": c("rot") / 10, "tpsa_norm": c("tpsa") / 100, "heavy_norm": c("heavy") / 50}
    t = t.select(*LINE, (-4 - 100 * c("l_tax")).alias("y"), *(inputs.get(n, c(n)).alias(n) for n in RESCORING))
    x = by_rows(assembled(t, RESCORING).select(*LINE, "vina", "x", "y"))
    model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=4, seed=7).fit(x.where("l_orderkey % 5 <> 0"))
    told = by_tree(x, model, "each")
    rescored = F.greatest(F.lit(-12.0), F.least(F.lit(-4.0), c("prediction")))
    told = told.withColumn("rescored", rescored).withColumn("variance", F.aggregate(F.transform("each", lambda v: (v - c("rescored")) * (v - c("rescored"))), F.lit(0.0), lambda a, b: a + b) / F.size("each"))
    return told.select(*LINE, "rescored", (c("rescored") - c("vina")).alias("delta"), "variance", F.greatest(F.lit(0.1), F.least(F.lit(0.95), 1 - c("variance"))).alias("confidence"))


@query("e20_activity_class", "WITH a AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN least(1, value / 200) END AS p, least(11, greatest(3, value / 10)) AS pkd FROM events) SELECT event_id, CASE WHEN p >= 0.65 THEN 'active' WHEN p <= 0.35 THEN 'inactive' WHEN p IS NOT NULL THEN 'moderate' WHEN pkd >= 7 THEN 'active' WHEN pkd >= 6 THEN 'moderate' ELSE 'inactive' END AS class FROM a")
def activity_class(spark, d):
    """From a classifier's probability where there is one (0.65 and more, 0.35 and less), else from the value (7 and 6)."""
    probability = F.when(F.col("event_type") == "signup", F.least(F.lit(1.0), F.col("value") / 200))
    pkd = F.least(F.lit(11.0), F.greatest(F.lit(3.0), F.col("value") / 10))
    by_value = F.when(pkd >= 7, "active").when(pkd >= 6, "moderate").otherwise("inactive")
    by_probability = F.when(probability >= 0.65, "active").when(probability <= 0.35, "inactive").otherwise("moderate")
    return read(spark, d, "events").select("event_id", F.when(probability.isNull(), by_value).otherwise(by_probability).alias("class"))


@query("e14_forest_fit")
def forest_fit(spark, d):
    """A random forest on a hold-out split by order; returns its hold-out metrics."""
    x = training(spark, d)
    return scored(regressors()["forest"].fit(x.where("fold > 0")).transform(x.where("fold = 0")))


@query("f6_global_importance")
def global_importance(spark, d):
    """Importances of the forest, one row per feature; equal shares when the model has none."""
    model = regressors()["forest"].fit(training(spark, d))
    weights = [float(v) for v in model.featureImportances.toArray()]
    if not sum(weights):
        weights = [1 / len(INPUTS)] * len(INPUTS)
    return spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(v).alias("importance")) for n, v in zip(INPUTS, weights, strict=True)))).alias("t")).select("t.*")
