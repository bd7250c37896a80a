"""Catalogue queries: search, lookup, merging, graph. Compounds are `part`; suppliers are their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.expressions import contains_any
from ledgerline.functions.descriptors import with_descriptors
from ledgerline.plans.structures import _BASE, _VERDICT, assessed, lipinski_broken, structures
from ledgerline.functions.running import running
from ledgerline.registry import query
from ledgerline.sources.files import scratch
from ledgerline.sources.tables import read


@query("b1_name_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_brand), 're') OR contains(lower(p_type), 're') OR contains(p_partkey::VARCHAR, 're')")
def name_search(spark, d, text: str = "RE"):
    """Any of four name fields (name, brand, type, key) contains the text, in any case."""
    fields = [F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_partkey").cast("string")]
    return read(spark, d, "part").where(contains_any(fields, text)).select("p_partkey", "p_name")


@query("b2_use_search", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 're'))) > 0 OR len(list_filter(string_split(p_type, ' '), lambda x: contains(lower(x), 're'))) > 0")
def use_search(spark, d, text: str = "re"):
    """Any element of either of two arrays (words of the name, words of the type) contains the text."""
    within = lambda c: F.exists(F.split(c, " "), lambda x: F.contains(F.lower(x), F.lit(text.lower())))
    return read(spark, d, "part").where(within("p_name") | within("p_type")).select("p_partkey")


def property_filter(parts: DataFrame, name: str | None = None, kind: str | None = None, use: str | None = None, structure: str | None = None, least_score: float | None = None, most_weight: float | None = None, lipinski: bool | None = None, limit: int = 50) -> DataFrame:
    """Parts with descriptors that fit every predicate given: name, class, use and structure by substring, a score of at least
    (missing: 0), a weight of at most, Lipinski yes or no; the first `limit` by falling score."""
    low = lambda c, text: F.contains(F.lower(c), F.lit(text.lower()))
    tests = [
        (name, lambda v: low(F.col("p_name"), v)),
        (kind, lambda v: low(F.col("p_type"), v)),
        (use, lambda v: F.exists(F.split("p_name", " "), lambda x: low(x, v))),
        (structure, lambda v: F.contains("s", F.lit(v))),
        (least_score, lambda v: F.coalesce("qed", F.lit(0.0)) >= v),
        (most_weight, lambda v: F.col("mw") <= v),
        (lipinski, lambda v: (lipinski_broken() <= 1) == v),
    ]
    for value, test in tests:
        if value is not None:
            parts = parts.where(test(value))
    return parts.orderBy(F.desc(F.coalesce("qed", F.lit(0.0))), "p_partkey").limit(limit)


@query("b8_property_search", f"WITH {_BASE} SELECT p_partkey, p_brand, p_size, round(qed, 8) AS score FROM d JOIN part USING (p_partkey) WHERE contains(lower(p_name), 'e') AND contains(lower(p_type), 'o') AND len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'd'))) > 0 AND contains(s, '|') AND coalesce(qed, 0) >= 0.3 AND mw <= 900 AND ((mw > 500)::BIGINT + (logp > 5)::BIGINT + (hbd > 5)::BIGINT + (hba > 10)::BIGINT <= 1) ORDER BY qed DESC, p_partkey LIMIT 50")
def property_search(spark, d):
    t = with_descriptors(structures(spark, d))
    found = property_filter(t, name="E", kind="o", use="d", structure="|", least_score=0.3, most_weight=900, lipinski=True, limit=50)
    return found.select("p_partkey", "p_brand", "p_size", F.round("qed", 8).alias("score"))


@query("b5_key_resolution", """WITH q AS (SELECT DISTINCT unnest([lower(p_name), lower(p_brand), lower(string_split(p_name, ' ')[1]), lower(substr(p_name, 2, 5)), 'no such ' || p_size]) AS asked FROM part),
    h AS (SELECT asked, p_partkey, CASE WHEN lower(p_name) = asked THEN 0 WHEN lower(p_brand) = asked THEN 1 ELSE 2 END AS step FROM q JOIN part ON contains(lower(p_name), asked) OR contains(lower(p_brand), asked)),
    b AS (SELECT asked, min_by(p_partkey, row(step, p_partkey)) AS p_partkey, min(step)::BIGINT AS step FROM h GROUP BY asked) SELECT asked, p_partkey, step FROM q LEFT JOIN b USING (asked)""")
def key_resolution(spark, d):
    """Each asked key's part: the first with it as name, else the first with it as brand, else the first that has it anywhere in either; null if none.

    Asked is every name, brand, first word and a piece of a name, in lower case, and keys that nothing has.
    """
    t = read(spark, d, "part").select("p_partkey", *(F.lower(c).alias(c) for c in ("p_name", "p_brand")), "p_size")
    asked = t.select(F.explode(F.array("p_name", "p_brand", F.get(F.split("p_name", " "), 0), F.substring("p_name", 2, 5), F.concat(F.lit("no such "), F.col("p_size").cast("string")))).alias("asked")).where("asked is not null").distinct()
    return resolved(asked, t.select("p_partkey", F.explode(F.array(*(F.struct(F.col(c).alias("text"), F.lit(i).cast("long").alias("step")) for i, c in enumerate(("p_name", "p_brand"))))).alias("e")).select("p_partkey", "e.*").where("text is not null"))


#: Characters by which a text is listed for the search of what it contains; a parameter.
LISTED = 3


def resolved(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """asked(asked), texts(p_partkey, text, step) → asked, p_partkey, step: equality in the order of steps, then, as step 2, the smallest part that contains the key.

    Each different text is listed once under its runs of LISTED characters (and shorter ones), with its smallest part; a key that no text equals
    meets the texts listed under its first characters, so no key is compared with every text.
    """
    equal = asked.join(texts, F.col("asked") == F.col("text")).groupBy("asked").agg(F.min(F.struct("step", "p_partkey")).alias("b")).select("asked", "b.p_partkey", "b.step")
    distinct = texts.groupBy("text").agg(F.min("p_partkey").alias("p_partkey"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LISTED)), lambda n: F.when(n <= F.length("text"), F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n))).otherwise(F.array().cast("array<string>"))))
    listed = distinct.select("text", "p_partkey", F.explode(F.array_distinct(runs)).alias("run"))
    rest = asked.join(equal, "asked", "left_anti").where("asked <> ''").withColumn("run", F.substring("asked", 1, LISTED))
    held = rest.join(listed, "run").where(F.contains("text", "asked")).groupBy("asked").agg(F.min("p_partkey").alias("p_partkey")).withColumn("step", F.lit(2).cast("long"))
    return asked.join(equal.unionByName(held), "asked", "left")


@query("b6_compounds_of_source", "SELECT s_nationkey, count(DISTINCT l_partkey)::BIGINT AS compounds FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1")
def compounds_of_source(spark, d):
    pairs = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey").agg(F.count_distinct("l_partkey").alias("compounds"))


@query("b11_merged_uses", "SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ' ') AS uses, count(*)::BIGINT AS n FROM part GROUP BY p_brand")
def merged_uses(spark, d):
    t = read(spark, d, "part")
    uses = t.select("p_brand", F.explode(F.split("p_name", " ")).alias("u")).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("u")), " ").alias("uses"))
    return uses.join(t.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand")


def graph_nodes(spark, d) -> DataFrame:
    """Nodes of the network: suppliers as plants, parts as compounds."""
    plants = read(spark, d, "supplier").select(F.concat(F.lit("plant_"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("plant").alias("type"), F.col("s_name").alias("label"))
    compounds = read(spark, d, "part").select(F.concat(F.lit("compound_"), F.col("p_partkey").cast("string")).alias("id"), F.lit("compound").alias("type"), F.col("p_name").alias("label"))
    return plants.unionByName(compounds)


def graph_edges(spark, d) -> DataFrame:
    """Distinct `contains` edges from plants to compounds."""
    pairs = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return pairs.select(F.concat(F.lit("plant_"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("compound_"), F.col("l_partkey").cast("string")).alias("target"), F.lit("contains").alias("type"))


_NODES = "nodes AS (SELECT 'plant_' || s_suppkey AS id, 'plant' AS type, s_name AS label FROM supplier UNION ALL SELECT 'compound_' || p_partkey, 'compound', p_name FROM part), edges AS (SELECT DISTINCT 'plant_' || l_suppkey AS source, 'compound_' || l_partkey AS target FROM lineitem)"


@query("b13_graph_nodes", f"WITH {_NODES} SELECT * FROM nodes")
def network_nodes(spark, d):
    return graph_nodes(spark, d)


@query("b13_graph_edges", f"WITH {_NODES} SELECT source, target, 'contains' AS type FROM edges")
def network_edges(spark, d):
    return graph_edges(spark, d)


@query("b13_graph_counts", f"WITH {_NODES} SELECT type, count(*)::BIGINT AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'contains', count(*) FROM edges")
def graph_counts(spark, d):
    """Nodes and edges by type."""
    return graph_nodes(spark, d).select("type").unionByName(graph_edges(spark, d).select("type")).groupBy("type").agg(F.count("*").alias("n"))


def subgraph(nodes: DataFrame, edges: DataFrame, kind: str | None, text: str | None, most: int = 220) -> tuple[DataFrame, DataFrame]:
    """At most `most` nodes of a type whose label or id contains a text, and the edges with both ends among them.

    Nodes of kind None are of any type. The first nodes by type (plants first) and id are taken.
    """
    if kind:
        nodes = nodes.where(F.col("type") == kind)
    if text:
        nodes = nodes.where(contains_any([F.col("label"), F.col("id")], text))
    kept = nodes.orderBy(F.desc("type"), "id").limit(most)
    ids = F.broadcast(kept.select("id"))  # at most `most` rows
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, inside


@query("b16_induced_subgraph", f"WITH {_NODES}, kept AS (SELECT * FROM nodes WHERE contains(lower(label), 'e') OR contains(lower(id), 'e') ORDER BY type DESC, id LIMIT 220) SELECT source, target FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)")
def induced_subgraph(spark, d):
    return subgraph(graph_nodes(spark, d), graph_edges(spark, d), None, "e")[1].select("source", "target")


@query("b14_first_per_id", "SELECT l_partkey, min_by(l_suppkey, row(l_orderkey, l_linenumber, l_suppkey)) AS first_source FROM lineitem GROUP BY 1")
def first_per_id(spark, d):
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("first_source"))


#: Other names of a formulation.
ALIASES = {"rush": "1-URGENT", "urgent": "1-URGENT"}


@query("b3_formulation_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def formulation_filter(spark, d, asked: str = " Rush "):
    """An alias stands for a fixed list of formulations; other names stand for themselves."""
    name = ALIASES.get(asked.strip().lower(), asked.strip())
    wanted = ["1-URGENT", "2-HIGH"] if name == "1-URGENT" else [name]
    return read(spark, d, "orders").where(F.col("o_orderpriority").isin(*wanted)).select("o_orderkey")


@query("b4_limit_and_count", "WITH m AS (SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a')) SELECT p_partkey, p_name, (SELECT count(*) FROM m)::BIGINT AS total FROM m ORDER BY p_name, p_partkey LIMIT 20")
def limit_and_count(spark, d):
    """The first twenty matches, each with the number of all matches."""
    m = read(spark, d, "part").where(F.contains("p_name", F.lit("a"))).select("p_partkey", "p_name")
    total = m.agg(F.count("*").alias("total"))
    return m.orderBy("p_name", "p_partkey").limit(20).crossJoin(F.broadcast(total))  # one row


@query("b6_compounds_with_fallback", """WITH n AS (SELECT n_nationkey, lower(n_name) AS name FROM nation), e AS (SELECT DISTINCT s_nationkey AS n_nationkey, l_partkey AS p_partkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey),
    f AS (SELECT n_nationkey, p_partkey FROM n JOIN part ON contains(p_partkey::VARCHAR, regexp_extract(name, '[0-9]+')) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM e)) SELECT n_nationkey, count(*)::BIGINT AS compounds FROM (SELECT * FROM e UNION ALL SELECT * FROM f) GROUP BY 1""")
def compounds_with_fallback(spark, d):
    """Compounds by equality of the source; a source without any takes the keys that contain its number."""
    nations = read(spark, d, "nation").select("n_nationkey", F.regexp_extract("n_name", "[0-9]+", 0).alias("digits"))
    lines = read(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    equal = lines.join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("n_nationkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    rest = nations.join(equal.select("n_nationkey").distinct(), "n_nationkey", "left_anti")
    contained = read(spark, d, "part").select("p_partkey").join(F.broadcast(rest), F.contains(F.col("p_partkey").cast("string"), F.col("digits")))  # at most 25 nations
    return equal.unionByName(contained.select("n_nationkey", "p_partkey")).groupBy("n_nationkey").agg(F.count("*").alias("compounds"))


@query("b7_compounds_described", f"WITH {_BASE}, {_VERDICT}, l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT l_suppkey, l_partkey, CASE WHEN p_partkey IS NULL THEN 'no structure' END AS error, round(mw, 8) AS mw, round(logp, 8) AS logp, round(qed, 8) AS qed, verdict FROM l LEFT JOIN w ON p_partkey = l_partkey WHERE p_partkey IS NULL OR (verdict <> 'FAIL_PAINS' AND passed >= 1)")
def compounds_described(spark, d, druglike: bool = True):
    """Compounds of each source with their descriptors; one without a structure stays, with an error.

    druglike: leave out compounds with an alert verdict or no filter passed.
    """
    t = assessed(spark, d).select("p_partkey", "mw", "logp", "qed", "verdict", "passed")
    lines = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    out = lines.join(t, F.col("l_partkey") == F.col("p_partkey"), "left")
    if druglike:
        out = out.where("p_partkey is null or (verdict <> 'FAIL_PAINS' AND passed >= 1)")
    error = F.when(F.col("p_partkey").isNull(), "no structure").alias("error")
    return out.select("l_suppkey", "l_partkey", error, *(F.round(c, 8).alias(c) for c in ("mw", "logp", "qed")), "verdict")


@query("b9_record_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_custkey || ' ' || c_name || ' ' || c_nationkey || ' ' || c_mktsegment), 'furn')")
def record_search(spark, d):
    """A record matches when any of its fields contains the text."""
    row = F.lower(F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
    return read(spark, d, "customer").where(F.contains(row, F.lit("furn"))).select("c_custkey")


@query("b10_point_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 42 OR p_brand = 'CID42' ORDER BY p_partkey LIMIT 1")
def point_lookup(spark, d):
    return read(spark, d, "part").where((F.col("p_partkey") == 42) | (F.col("p_brand") == "CID42")).orderBy("p_partkey").limit(1).select("p_partkey", "p_name")


@query("b12_formulation_names", """WITH f AS (SELECT o_orderpriority, p_name, min((o_orderkey, l_linenumber)) AS first FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY first, p_name)::BIGINT AS position, p_name FROM f""")
def formulation_names(spark, d):
    """Distinct compound names of each formulation, a row each, numbered in the order of their first sight.

    The numbers come from counts of ranges of that order, so no formulation is gathered in one task.
    """
    lines = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey", "p_name").agg(F.min("l_linenumber").alias("line"))
    first = lines.join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority", "p_name").agg(F.min(F.struct("o_orderkey", "line")).alias("first"))
    named = first.select("o_orderpriority", "p_name", "first.*", F.lit(1).cast("long").alias("one"))
    told = running(named, ["o_orderpriority", "o_orderkey", "line", "p_name"], ("one",), within="o_orderpriority")
    return told.select("o_orderpriority", F.col("up_to_one").alias("position"), "p_name")


@query("b15_formulation_detail", """WITH l AS (SELECT DISTINCT o_orderpriority, l_suppkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey), c AS (SELECT o_orderpriority, count(DISTINCT l_partkey)::BIGINT AS distinct_compounds FROM l GROUP BY 1)
    SELECT o_orderpriority, l_suppkey, s_name AS plant, count(*)::BIGINT AS n, md5(string_agg(l_partkey::VARCHAR, ';' ORDER BY l_partkey)) AS compounds, any_value(distinct_compounds) AS distinct_compounds FROM l LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s_suppkey = l_suppkey JOIN c USING (o_orderpriority) GROUP BY 1, 2, 3""")
def formulation_detail(spark, d):
    """Constituents of each formulation with their plant (null if unknown), the compounds of each, and the formulation's distinct ones.

    A constituent's compounds are put together per formulation and supplier, not per formulation; compounds: the md5 of their list.
    """
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    l = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderpriority", "l_suppkey", "l_partkey").distinct()  # noqa: E741
    known = read(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_name").alias("plant"))
    own = l.groupBy("o_orderpriority", "l_suppkey").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("l_partkey")).cast("array<string>"), ";")).alias("compounds"))
    total = l.select("o_orderpriority", "l_partkey").distinct().groupBy("o_orderpriority").agg(F.count("*").alias("distinct_compounds"))
    return own.join(known, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(total, "o_orderpriority").drop("s_suppkey")


_INVERTED = "t AS (SELECT 'name' AS kind, lower(p_name) AS key, p_partkey AS id FROM part UNION ALL SELECT 'alternate', lower(p_brand), p_partkey FROM part UNION ALL SELECT 'use', lower(unnest(string_split(p_name, ' '))), p_partkey FROM part UNION ALL SELECT 'plant', l_suppkey::VARCHAR, l_partkey FROM lineitem)"


@query("b17_lookup_tables", f"WITH {_INVERTED} SELECT kind, key, count(DISTINCT id)::BIGINT AS ids, min(id) AS first FROM t GROUP BY 1, 2")
def lookup_tables(spark, d):
    """Inverted index as long rows (kind, key, id), summed per key."""
    return inverted(spark, d).groupBy("kind", "key").agg(F.count("*").alias("ids"), F.min("id").alias("first"))


@query("b17_lookup", f"WITH {_INVERTED}, q AS (SELECT DISTINCT lower(n_name) AS key FROM nation UNION SELECT DISTINCT lower(string_split(p_name, ' ')[1]) FROM part UNION SELECT lower(p_brand) FROM part UNION SELECT s_suppkey::VARCHAR FROM supplier) SELECT DISTINCT kind, key, id FROM t JOIN q USING (key)")
def lookup(spark, d):
    """The ids, a row each, of the keys asked for: first words, brands, suppliers, nations (which have none)."""
    asked = read(spark, d, "nation").select(F.lower("n_name").alias("key"))
    parts = read(spark, d, "part")
    for more in (parts.select(F.lower(F.get(F.split("p_name", " "), 0)).alias("key")), parts.select(F.lower("p_brand").alias("key")), read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("key"))):
        asked = asked.unionByName(more)
    return looked_up(stored_lookups(inverted(spark, d)), asked)


#: Files into which keys of the stored lookups are dealt; a parameter, to be set by the size of the index.
BUCKETS = 16


def stored_lookups(index: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The long rows (kind, key, id) as a table bucketed and sorted by key: a search for one key reads one bucket, a join by key moves none of it."""
    spark = index.sparkSession
    path = scratch(spark, "lookup")
    name = f"lookup_{path.rpartition('-')[2]}"
    index.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
    return spark.table(name)


def looked_up(index: DataFrame, asked: DataFrame) -> DataFrame:
    return index.join(asked.distinct(), "key").select("kind", "key", "id")


def inverted(spark, d) -> DataFrame:
    """Distinct long rows of the lookup tables: name, alternate name, use → compounds, plant → compounds."""
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.lower(key).alias("key"))
    uses = F.transform(F.split("p_name", " "), lambda u: entry("use", u))
    both = F.concat(F.array(entry("name", F.col("p_name")), entry("alternate", F.col("p_brand"))), uses)
    of_parts = read(spark, d, "part").select(F.explode(both).alias("e"), F.col("p_partkey").alias("id")).select("e.kind", "e.key", "id")
    of_plants = read(spark, d, "lineitem").select(F.lit("plant").alias("kind"), F.col("l_suppkey").cast("string").alias("key"), F.col("l_partkey").alias("id"))
    return of_parts.unionByName(of_plants).distinct()
