"""Provenance and reference checks: names of `customer` and `part`, titles of `pages` against `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.expressions import significant_words
from ledgerline.registry import query
from ledgerline.sources.tables import read

_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"
_SIG = r"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: length(w) >= 4 AND w NOT IN ('http', 'example')))"


def titles(spark, d) -> DataFrame:
    """Pages with the title that their HTML names."""
    return read(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def plausible(expected: Column, actual: Column) -> Column:
    """Two significant words of the expected title occur in the other one, or one of eight letters, or one of at most two."""
    hits = F.filter(expected, lambda w: F.contains(F.lower(actual), w))
    return (F.size(hits) >= 2) | F.exists(hits, lambda w: F.length(w) >= 8) | ((F.size(expected) <= 2) & (F.size(hits) == 1))


_MATCH = f"""m AS (SELECT page_id, {_TITLE} AS title, {_SIG.format(c=_TITLE)} AS e, doc_id, text FROM pages LEFT JOIN documents ON doc_id = page_id), h AS (SELECT *, list_filter(e, lambda w: contains(lower(text), w)) AS hits FROM m),
    p AS (SELECT *, len(hits) >= 2 OR len(list_filter(hits, lambda w: length(w) >= 8)) > 0 OR (len(e) <= 2 AND len(hits) = 1) AS ok FROM h)"""


def matched(spark, d) -> DataFrame:
    """Each page beside the document of its number, with whether its title fits that text."""
    e = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), 0)), lambda w: (F.length(w) >= 4) & ~w.isin("http", "example"))
    docs = read(spark, d, "documents").select("doc_id", "text")
    return titles(spark, d).join(docs, F.col("doc_id") == F.col("page_id"), "left").select("page_id", "title", "doc_id", plausible(e, F.col("text")).alias("ok"), F.length("text").alias("size"))


@query("j1_distinct_names", "SELECT trim(o_orderpriority) AS name, min(o_orderkey) AS first FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1")
def distinct_names(spark, d):
    """Trimmed names that are not blank, each with its first row."""
    return read(spark, d, "orders").select(F.trim("o_orderpriority").alias("name"), "o_orderkey").where("name <> ''").groupBy("name").agg(F.min("o_orderkey").alias("first"))


@query("j2_significant_words", "SELECT page_id, len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(url), '[^a-z ]', '', 'g'), ' +'), lambda w: length(w) >= 4)))::BIGINT AS n FROM pages")
def page_words(spark, d):
    return read(spark, d, "pages").select("page_id", F.size(significant_words(F.col("url"))).cast("long").alias("n"))


@query("j3_title_match", f"WITH {_MATCH} SELECT page_id, coalesce(ok, false) AS ok FROM p")
def title_match(spark, d):
    return matched(spark, d).select("page_id", F.coalesce("ok", F.lit(False)).alias("ok"))


@query("j4_enrichment", "SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN 'unresolved: no record' ELSE 'resolved' END AS state FROM customer LEFT JOIN supplier ON replace(c_name, 'Customer', 'Supplier') = s_name")
def enrichment(spark, d):
    """Names looked up in the enrichment table; misses stay, with a reason."""
    known = read(spark, d, "supplier").select("s_name", "s_suppkey")
    t = read(spark, d, "customer").withColumn("s_name", F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).join(known, "s_name", "left")
    return t.select("c_custkey", F.when(F.col("s_suppkey").isNull(), "unresolved: no record").otherwise("resolved").alias("state"))


@query("j5_structure_audit", f"WITH {_MATCH} SELECT page_id, coalesce(length(text), 0)::BIGINT AS size, CASE WHEN doc_id IS NULL THEN 'missing' WHEN ok THEN 'match' ELSE 'mismatch' END AS status FROM p")
def structure_audit(spark, d):
    status = F.when(F.col("doc_id").isNull(), "missing").when(F.col("ok"), "match").otherwise("mismatch")
    return matched(spark, d).select("page_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), status.alias("status"))


@query("j6_reference_table", f"WITH {_MATCH} SELECT page_id, title, CASE WHEN ok THEN 'verified' ELSE 'check by hand' END AS note FROM p")
def reference_table(spark, d):
    return matched(spark, d).select("page_id", "title", F.when(F.col("ok"), "verified").otherwise("check by hand").alias("note"))


@query("j7_run_summary", f"""WITH {_MATCH} SELECT 'enrichment' AS source, count(*)::BIGINT AS total, count(s_suppkey)::BIGINT AS good FROM customer LEFT JOIN supplier ON replace(c_name, 'Customer', 'Supplier') = s_name
    UNION ALL SELECT 'references', count(*), count(*) FILTER (ok) FROM p""")
def run_summary(spark, d):
    found = enrichment(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("state") == "resolved").alias("good"))
    refs = matched(spark, d).agg(F.count("*").alias("total"), F.count_if("ok").alias("good"))
    return found.select(F.lit("enrichment").alias("source"), "*").unionByName(refs.select(F.lit("references").alias("source"), "*"))
