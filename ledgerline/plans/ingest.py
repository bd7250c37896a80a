"""Sources and sinks: tables rendered to files in the session's shared folder and read back; reports."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.evidence import _OUT, _RANK, numbered, outputs, priorities
from ledgerline.plans.models import INPUTS, regressors, scaled, scored, training
from ledgerline.registry import query
from ledgerline.sources.files import parse_references, read_catalogue, read_coordinates, read_logs, read_results, read_training, resume, scratch, split_models
from ledgerline.sources.tables import read

_CATALOGUE = "p_partkey bigint, p_name string, p_brand string"


def catalogue(spark, d) -> DataFrame:
    """`part` as flat JSON rows for even keys and as objects with a nested list for odd ones."""
    t = read(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    path = scratch(spark, "catalogue")
    t.where("p_partkey % 2 = 0").write.json(f"{path}/flat")
    t.where("p_partkey % 2 = 1").select(F.array(F.struct("*")).alias("records")).write.json(f"{path}/nested")
    return read_catalogue(spark, f"{path}/*", _CATALOGUE)


@query("a1_catalogue_scan", "SELECT count(*)::BIGINT AS rows, count(DISTINCT p_brand)::BIGINT AS brands, count(DISTINCT p_name)::BIGINT AS names FROM part")
def catalogue_scan(spark, d):
    return catalogue(spark, d).agg(F.count("*").alias("rows"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_name").alias("names"))


@query("a2_normalised", "WITH u AS (SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ' ') AS uses, min(p_partkey) AS first FROM part GROUP BY 1) SELECT * FROM u")
def normalised(spark, d):
    """One plant per name: its first row, and the sorted union of its uses."""
    t = catalogue(spark, d).select("p_brand", "p_partkey", F.explode(F.split("p_name", " ")).alias("use"))
    return t.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("use")), " ").alias("uses"), F.min("p_partkey").alias("first"))


@query("a2_compounds", "SELECT p_partkey, coalesce(p_name, p_brand, 'compound ' || p_partkey) AS structure, p_brand AS plant FROM part")
def compounds(spark, d):
    """One compound per row, with the first structure that is there."""
    t = catalogue(spark, d)
    return t.select("p_partkey", F.coalesce("p_name", "p_brand", F.concat(F.lit("compound "), F.col("p_partkey").cast("string"))).alias("structure"), F.col("p_brand").alias("plant"))


@query("a2_formulations", "SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS formulation, p_name AS compound FROM part")
def formulations(spark, d):
    """Formulations (words of the names) and the names of their compounds, as long rows."""
    return catalogue(spark, d).select(F.explode(F.split(F.lower("p_name"), " ")).alias("formulation"), F.col("p_name").alias("compound")).distinct()


@query("a3_target_scan", "SELECT n_nationkey AS id, n_name AS gene, n_regionkey::DOUBLE AS cx, n_nationkey * 2.5::DOUBLE AS size FROM nation")
def target_scan(spark, d):
    path = scratch(spark, "targets")
    site = F.struct(F.col("n_regionkey").cast("double").alias("cx"), (F.col("n_nationkey") * 2.5).alias("size"))
    read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("gene"), site.alias("site")).write.json(path)
    return spark.read.schema("id int, gene string, site struct<cx: double, size: double>").json(path).select("id", "gene", "site.*")


@query("a4_corpus_scan", "SELECT doc_id, md5(text) AS h, 'json' AS origin FROM documents WHERE text IS NOT NULL UNION ALL SELECT item_id, md5(text), 'list' FROM benchmark")
def corpus_scan(spark, d):
    """The corpus written as JSON and read again, together with a list of a category."""
    path = scratch(spark, "corpus")
    read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").write.json(path)
    docs = spark.read.schema("doc_id bigint, text string").json(path).withColumn("origin", F.lit("json"))
    more = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("list").alias("origin"))
    return docs.unionByName(more).select("doc_id", F.md5("text").alias("h"), "origin")


@query("a4_paper_scan", "SELECT item_id AS paper, md5(text) AS h FROM benchmark WHERE text IS NOT NULL")
def paper_scan(spark, d):
    """A folder of plain texts, a file or folder for each paper, read whole; a paper's number is in its path."""
    path = scratch(spark, "papers")
    read(spark, d, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("paper"), F.col("text").alias("value")).write.partitionBy("paper").text(path)
    t = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    number = F.regexp_extract("path", r"paper=(\d+)", 1).cast("long")
    return t.select(number.alias("paper"), F.md5(F.regexp_replace("value", "\n$", "")).alias("h"))


@query("a10_enrichment_scan", "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 25 THEN 'resolved' ELSE 'unresolved' END AS status, round(p_retailprice, 4) AS weight FROM part")
def enrichment_scan(spark, d):
    """Enrichment results as JSON documents that nest a list of results, read with an explicit schema and listed again."""
    path = scratch(spark, "enrichment")
    result = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "resolved").otherwise("unresolved").alias("status"), F.round("p_retailprice", 4).alias("weight"))
    read(spark, d, "part").select(F.lit("enrichment").alias("kind"), F.array(result).alias("results")).write.json(path)
    return read_results(spark, path, "id bigint, name string, status string, weight double")


@query("a5_coordinate_scan", "SELECT vec_id % 99999 AS serial, label::BIGINT AS residue, (vec_id % 100) / 10.0::DOUBLE AS x, label::DOUBLE AS y, floor(embedding[1]::DOUBLE * 100)::DOUBLE AS z FROM embeddings")
def coordinate_scan(spark, d):
    """Vectors as fixed-width lines, and these read again."""
    x = F.format_string("%8.3f", (F.col("vec_id") % 100) / 10)
    z = F.floor(F.element_at("embedding", 1).cast("double") * 100).cast("double")
    line = F.format_string("ATOM  %5d  CA  GLY A%4d    %s%8.3f%8.3f", F.col("vec_id") % 99999, "label", x, F.col("label").cast("double"), z)
    path = scratch(spark, "atoms")
    read(spark, d, "embeddings").select(line.alias("value")).write.text(path)
    return read_coordinates(spark, path)


@query("a6_docking_logs", "SELECT l_suppkey % 5 AS target, CASE WHEN l_suppkey % 5 = 4 THEN 0 ELSE l_linenumber END::BIGINT AS mode, count(*)::BIGINT AS n, round(min(round(-4 - 80 * l_discount, 1)), 4) AS best FROM lineitem GROUP BY 1, 2")
def docking_logs(spark, d):
    """Logs by target; those of target 4 have no table, only loose lines."""
    a = -4 - 80 * F.col("l_discount")
    row = F.format_string("%4d  %10.1f  %9.3f  %9.3f", "l_linenumber", a, 50 * F.col("l_tax"), 75 * F.col("l_tax"))
    target = (F.col("l_suppkey") % 5).alias("target")
    line = F.when(F.col("l_suppkey") % 5 == 4, F.format_string("Affinity: %.1f (kcal/mol)", a)).otherwise(row)
    path = scratch(spark, "logs")
    read(spark, d, "lineitem").select(target, line.alias("value")).write.partitionBy("target").text(path)
    t = read_logs(spark, path, "target")
    return t.groupBy(F.col("target").cast("long").alias("target"), "mode").agg(F.count("*").alias("n"), F.round(F.min("affinity"), 4).alias("best"))


@query("a7_split_models", "SELECT o_orderkey, 0::BIGINT AS pos, CASE WHEN o_orderkey % 10 = 0 THEN 'plain ' || o_orderstatus ELSE o_orderstatus END AS block FROM orders UNION ALL SELECT o_orderkey, 1, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0")
def model_blocks(spark, d):
    text = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("plain "), "o_orderstatus")).otherwise(F.format_string("MODEL 1\n%s\nENDMDL\nMODEL 2\n%s\nENDMDL\n", "o_orderstatus", "o_orderpriority"))
    t = read(spark, d, "orders").select("o_orderkey", F.posexplode(split_models(text)).alias("pos", "block"))
    return t.withColumn("pos", F.col("pos").cast("long"))


@query("a8_training_csv", "SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part")
def training_csv(spark, d):
    path = scratch(spark, "training")
    read(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("string").alias("p_retailprice")).write.option("header", True).csv(path)
    return read_training(spark, path, ("p_size", "p_retailprice")).withColumn("p_partkey", F.col("p_partkey").cast("long"))


_RAW = "'Anon et al. ' || replace(regexp_extract(html, '<title>([^<]*)</title>', 1), chr(10), ' ') || '. Journal'"


@query("a9_reference_list", f"WITH r AS (SELECT page_id AS no, {_RAW} AS raw FROM pages), c AS (SELECT *, list_filter(string_split(raw, '. '), lambda x: len(regexp_split_to_array(trim(x), ' +')) >= 4) AS c FROM r) SELECT no, trim(c[1]) AS title, raw FROM c")
def reference_list(spark, d):
    title = F.replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("["), F.col("page_id").cast("string"), F.lit("] Anon et al. "), title, F.lit(". Journal"))
    path = scratch(spark, "references")
    read(spark, d, "pages").select(line.alias("value")).write.text(path)
    return parse_references(spark.read.text(path), "value")


@query("a12_markdown_report", f"WITH {_OUT}, {_RANK}, r AS (SELECT user_id, round(score, 6) AS s FROM ranked ORDER BY 2 DESC, 1 LIMIT 10), n AS (SELECT *, row_number() OVER (ORDER BY s DESC, user_id) AS rank FROM r) SELECT '| ' || rank || ' | ' || user_id || ' |' AS line FROM n UNION ALL SELECT '| rank | candidate |' UNION ALL SELECT '| --- | --- |'")
def markdown_report(spark, d):
    """A table of the ten best candidates, one file of ordered lines, read back."""
    top = priorities(spark, d).select("user_id", F.round("score", 6).alias("s")).orderBy(F.desc("s"), "user_id").limit(10)
    rows = numbered(top, (-F.col("s")).alias("a"), F.col("user_id").alias("b")).select("rank", F.format_string("| %d | %d |", "rank", "user_id").alias("value"))
    head = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-1).alias("rank"), F.lit("| rank | candidate |").alias("value")), F.struct(F.lit(0).alias("rank"), F.lit("| --- | --- |").alias("value")))).alias("h")).select("h.*")
    path = scratch(spark, "report")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("rank").select("value").write.text(path)  # twelve lines
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("a14_saved_model")
def saved_model(spark, d):
    """Scaler and model, the feature list and the metrics, written and read again: the greatest difference of a prediction is 0."""
    x = training(spark, d)
    path = scratch(spark, "model")
    made = scaled(regressors()["ridge"]).fit(x)
    made.write().save(f"{path}/model")
    scored(made.transform(x)).write.json(f"{path}/metrics")
    spark.createDataFrame([(i, n) for i, n in enumerate(INPUTS)], "at int, feature string").write.json(f"{path}/features")
    again = PipelineModel.load(f"{path}/model")
    again.stages[-1].setPredictionCol("again")
    features = spark.read.schema("at int, feature string").json(f"{path}/features").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "feature")))["feature"], ";").alias("features"))
    metrics = spark.read.schema("n bigint, rmse double, r2 double").json(f"{path}/metrics").select("rmse")
    both = made.transform(x).select("l_orderkey", "x", "prediction")
    difference = again.transform(both.withColumnRenamed("prediction", "first")).agg(F.count("*").alias("n"), F.max(F.abs(F.col("first") - F.col("again"))).alias("difference"))
    return difference.crossJoin(F.broadcast(features)).crossJoin(F.broadcast(metrics))  # one row each


@query("a15_resumed_stage", "SELECT l_returnflag, count(*)::BIGINT AS n, 0::BIGINT AS rebuilt FROM lineitem GROUP BY 1")
def resumed_stage(spark, d):
    """A stage is built once; a second run reads what the first has written."""
    path = scratch(spark, "stage")
    build = lambda rebuilt: read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.lit(rebuilt).cast("long").alias("rebuilt"))
    resume(spark, path, lambda: build(0))
    return resume(spark, path, lambda: build(1))


@query("i7_json_report", f"""WITH {_OUT}, {_RANK}, t AS (SELECT user_id, outputs AS n, round(score, 3) AS score FROM ranked), s AS (SELECT user_id, string_agg(tier || '=' || n, ';' ORDER BY tier) AS tiers FROM (SELECT user_id, tier, count(*) AS n FROM outputs GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, n, score, tiers, CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS priority, false AS clinical_proof FROM t JOIN s USING (user_id)""")
def json_report(spark, d):
    """One JSON document per candidate (key, outputs, score, outputs by tier, priority, disclaimer flag), through the JSON sink and read again."""
    tiers_ = outputs(spark, d).groupBy("user_id", "tier").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("tier", "n"))).alias("tiers"))  # five tiers at most
    score = F.round("score", 3)
    priority = F.when(score >= 0.5, "high").when(score >= 0.3, "medium").otherwise("low")
    t = priorities(spark, d).join(tiers_, "user_id").select(F.col("user_id").alias("candidate"), F.col("outputs").alias("n"), score.alias("score"), "tiers", priority.alias("priority"), F.lit(False).alias("clinical_proof"))
    path = scratch(spark, "reports")
    t.write.json(path)
    again = spark.read.schema("candidate bigint, n bigint, score double, tiers array<struct<tier: string, n: bigint>>, priority string, clinical_proof boolean").json(path)
    by_tier = F.array_join(F.transform("tiers", lambda x: F.concat(x["tier"], F.lit("="), x["n"].cast("string"))), ";")
    return again.select(F.col("candidate").alias("user_id"), "n", "score", by_tier.alias("tiers"), "priority", "clinical_proof")


@query("i8_candidate_sections", f"WITH {_OUT}, {_RANK}, t AS (SELECT user_id FROM ranked ORDER BY round(score, 6) DESC, user_id LIMIT 3), o AS (SELECT user_id, tier, event_id, row_number() OVER (PARTITION BY user_id, tier ORDER BY event_id)::BIGINT AS nth FROM outputs JOIN t USING (user_id)) SELECT * FROM o WHERE nth <= 2")
def candidate_sections(spark, d):
    """Two outputs of each tier for the three best candidates."""
    top = priorities(spark, d).select("user_id", F.round("score", 6).alias("s")).orderBy(F.desc("s"), "user_id").limit(3)
    mine = outputs(spark, d).join(F.broadcast(top), "user_id")  # three rows
    first = mine.groupBy("user_id", "tier").agg(F.min("event_id").alias("first"))
    second = mine.join(first, ["user_id", "tier"]).where("event_id > first").groupBy("user_id", "tier").agg(F.min("event_id").alias("event_id"))
    one = F.lit(1).cast("long").alias("nth")
    return first.select("user_id", "tier", F.col("first").alias("event_id"), one).unionByName(second.withColumn("nth", F.lit(2).cast("long")).select("user_id", "tier", "event_id", "nth"))


@query("i10_run_response", f"WITH {_OUT} SELECT string_agg(tier || '=' || n, ';' ORDER BY tier) AS tiers, sum(n)::BIGINT AS total FROM (SELECT tier, count(*) AS n FROM outputs GROUP BY 1)")
def run_response(spark, d):
    t = outputs(spark, d).groupBy("tier").agg(F.count("*").alias("n"))  # five rows
    return t.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tier", "n"))), lambda x: F.concat(x["tier"], F.lit("="), x["n"].cast("string"))), ";").alias("tiers"), F.sum("n").alias("total"))
