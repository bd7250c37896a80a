"""Evidence tiers, validation and candidate ranking.

Tiered outputs are `events`: the event type gives the tier, confidence = least(1, value / 100), candidate = user,
and k of props gives the metadata (score -k/10, rmsd k/25, clash, strain k/20, domain flag, expected tier).
Answers are the assistant turns of `conversations`, with a reference and, for some, a claim appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.registry import query
from ledgerline.sources.tables import read

#: Tier, event type, ranking weight; the order is the tier number.
TIERS = (
    ("database_derived", "view", 0.15),
    ("molecular_docking_result", "click", 0.30),
    ("machine_learning_prediction", "signup", 0.30),
    ("explainable_ai_interpretation", "error", 0.10),
    ("literature_derived_llm_synthesized", "purchase", 0.15),
)
#: Phrases that no computational output may contain, in four lists.
TIER_PHRASES = (
    "clinically proven",
    "proven effective",
    "clinical efficacy demonstrated",
    "safe for human use based on this result",
    "approved drug based on this docking",
    "confirmed therapeutic",
)
OUTPUT_PHRASES = (
    "clinically proven",
    "efficacious in patients",
    "therapeutic dose",
    "cures",
    "treats disease",
    "clinical efficacy",
)
BLOCKED_PHRASES = (
    "clinically proven",
    "proven to cure",
    "proven to treat",
    "effective treatment for patients",
    "clinical efficacy demonstrated",
    "will cure",
    "guaranteed to work",
    "safe and effective in humans",
    "therapeutic effect confirmed",
    "can be used to treat patients",
    "clinical proof",
    "cures disease",
    "treats disease in humans",
    "approved drug based on this",
    "safe for human use based on this result",
    "efficacious in patients",
)
SHOWN_PHRASES = (
    "clinically proven",
    "proves efficacy",
    "demonstrates therapeutic effect",
    "cures",
    "treats disease",
    "clinical proof",
    "proven to treat",
    "effective treatment for",
    "approved drug",
    "clinical efficacy confirmed",
)
FORBIDDEN = tuple(dict.fromkeys((*TIER_PHRASES, *OUTPUT_PHRASES, *BLOCKED_PHRASES, *SHOWN_PHRASES)))
#: What each tier is, and how far it may be trusted; tiers 2 and 3 carry the disclaimer.
ABOUT = (
    ("taken from a curated database", "high if the source is curated"),
    ("a docking score, a structural hypothesis", "medium to low, needs an experiment"),
    ("a prediction of a model, correlative", "as good as the model within its domain"),
    ("an interpretation of a model", "says how the model behaves"),
    ("written from retrieved literature", "as good as its citations"),
)
DISCLAIMER = "computational prediction, no clinical proof"
#: Patterns that claim more than a computation can show.
OVERCLAIMS = (
    r"\bclinically proven\b",
    r"\bproven to cure\b",
    r"\bproven to treat\b",
    r"\beffective treatment\b.*\bfor patients\b",
    r"\bclinical efficacy\b.*\bdemonstrated\b",
    r"\bwill cure\b",
    r"\bguaranteed to work\b",
    r"\bsafe and effective\b.*\bin humans\b",
    r"\btherapeutic effect\b.*\bconfirmed\b",
    r"\bcan be used to treat patients\b",
    r"\bclinical proof\b",
)
#: Claims that the test answers carry, by conv_id mod 8.
CLAIMS = ("It is clinically proven.", "A docking score shows that it cures covid.", "Clinical efficacy was demonstrated.")

_DIM = "tiers AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{e}', {w}::DOUBLE, {i}::BIGINT)" for i, (t, e, w) in enumerate(TIERS, 1)) + ") AS t(tier, event_type, weight, tier_no))"
_OUT = f"""{_DIM}, ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), outputs AS (SELECT event_id, user_id, tier, tier_no, weight, k, least(1, value / 100) AS confidence,
    -k / 10.0::DOUBLE AS score, k / 25.0::DOUBLE AS rmsd, (k % 13 = 0)::BIGINT AS clashes, k / 20.0::DOUBLE AS strain, CASE WHEN k % 10 = 9 THEN NULL ELSE k % 3 <> 0 END AS inside, k % 5 + 1 AS expected FROM ev JOIN tiers USING (event_type))"""
_ANS = "answers AS (SELECT conv_id, turn, text || ' [REF_' || conv_id || '] ' || CASE conv_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLAIMS)) + " ELSE '' END AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)"


def tiers(spark) -> DataFrame:
    """The five tiers, five rows."""
    rows = [F.struct(F.lit(t).alias("tier"), F.lit(e).alias("event_type"), F.lit(w).alias("weight"), F.lit(i).cast("long").alias("tier_no")) for i, (t, e, w) in enumerate(TIERS, 1)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def outputs(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    t = read(spark, d, "events").withColumn("k", k).join(F.broadcast(tiers(spark)), "event_type")  # five rows
    confidence = F.least(F.lit(1.0), F.col("value") / 100)
    domain = F.expr("CASE WHEN k % 10 = 9 THEN NULL ELSE k % 3 <> 0 END")
    return t.select("event_id", "user_id", "tier", "tier_no", "weight", "k", "props", confidence.alias("confidence"), F.expr("-k / 10D").alias("score"), F.expr("k / 25D").alias("rmsd"), F.expr("if(k % 13 = 0, 1L, 0L)").alias("clashes"), F.expr("k / 20D").alias("strain"), domain.alias("inside"), F.expr("k % 5 + 1").alias("expected"))


def answers(spark, d) -> DataFrame:
    claim = F.lit("")
    for i, text in enumerate(CLAIMS):
        claim = F.when(F.col("conv_id") % 8 == i, text).otherwise(claim)
    t = read(spark, d, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    return t.select("conv_id", "turn", F.concat("text", F.lit(" [REF_"), F.col("conv_id").cast("string"), F.lit("] "), claim).alias("answer"))


def found(tests: list[tuple[Column, str]]) -> Column:
    """The names of the tests that hold."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in tests)), lambda x: x.isNotNull())


def overclaims(text: Column) -> Column:
    """Patterns matched in a text, and the rule that a computational term may not meet a claim of efficacy."""
    low = F.lower(text)
    has = lambda words: low.rlike("|".join(words))
    both = has(["docking score", "predicted affinity", "ml model"]) & has(["cures covid", "treats patients effectively", "proven effective in humans"])
    return found([*((low.rlike(p), p) for p in OVERCLAIMS), (both, "combined")])


_BOTH = "(regexp_matches(lower(answer), 'docking score|predicted affinity|ml model') AND regexp_matches(lower(answer), 'cures covid|treats patients effectively|proven effective in humans'))"
_N_OVER = "(" + " + ".join([f"regexp_matches(lower(answer), '{p}')::BIGINT" for p in OVERCLAIMS] + [f"{_BOTH}::BIGINT"]) + ")"


_ABOUT = "about AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{x}', '{g}', {repr(DISCLAIMER) if i in (2, 3) else 'NULL'})" for i, (x, g) in enumerate(ABOUT, 1)) + ") AS t(tier_no, description, guidance, disclaimer))"


def about(spark) -> DataFrame:
    """Description, guidance and disclaimer of each tier, five rows."""
    rows = [F.struct(F.lit(i).cast("long").alias("tier_no"), F.lit(x).alias("description"), F.lit(g).alias("guidance"), (F.lit(DISCLAIMER) if i in (2, 3) else F.lit(None).cast("string")).alias("disclaimer")) for i, (x, g) in enumerate(ABOUT, 1)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


@query("h1_tier_tags", f"WITH {_OUT}, {_ABOUT} SELECT event_id, tier_no, 'tier ' || tier_no || ': ' || tier AS label, description, guidance, disclaimer, false AS clinical_proof FROM outputs JOIN about USING (tier_no)")
def tier_tags(spark, d):
    t = outputs(spark, d).join(F.broadcast(about(spark)), "tier_no")  # five rows
    return t.select("event_id", "tier_no", F.format_string("tier %d: %s", "tier_no", "tier").alias("label"), "description", "guidance", "disclaimer", F.lit(False).alias("clinical_proof"))


@query("h2_tier_enforcement", f"WITH {_OUT} SELECT e.event_id, coalesce(t.tier, o.tier) AS tier, o.tier_no IS NOT NULL AND o.tier_no <> t.expected AS overridden, o.tier_no IS NULL AS wrapped FROM events e LEFT JOIN outputs o USING (event_id) LEFT JOIN (SELECT tier_no AS expected, tier FROM tiers) t ON t.expected = coalesce(o.expected, CAST(json_extract(e.props, '$.k') AS BIGINT) % 5 + 1)")
def tier_enforcement(spark, d):
    """The expected tier wins; a row whose own tier differs is flagged, and a row without one is wrapped in the expected one."""
    names = tiers(spark).select(F.col("tier_no").alias("expected"), F.col("tier").alias("kept"))
    own = outputs(spark, d).select("event_id", "tier", "tier_no")
    k = F.get_json_object("props", "$.k").cast("long")
    t = read(spark, d, "events").select("event_id", (k % 5 + 1).alias("expected")).join(own, "event_id", "left").join(F.broadcast(names), "expected", "left")
    return t.select("event_id", F.coalesce("kept", "tier").alias("tier"), (F.col("tier_no").isNotNull() & (F.col("tier_no") != F.col("expected"))).alias("overridden"), F.col("tier_no").isNull().alias("wrapped"))


@query("h3_confidence_cap", f"WITH {_OUT} SELECT event_id, tier, round(CASE WHEN tier_no IN (2, 3) THEN least(0.95::DOUBLE, confidence) ELSE confidence END, 6) AS confidence, coalesce(props::JSON ->> '$.disclaimer', CASE WHEN tier_no IN (2, 3) THEN '{DISCLAIMER}' END) AS disclaimer FROM outputs JOIN (SELECT event_id, props FROM events) USING (event_id)")
def confidence_cap(spark, d):
    """Docking and model tiers are never surer than 0.95, and carry a disclaimer where none is given."""
    computed = F.col("tier_no").isin(2, 3)
    capped = F.when(computed, F.least(F.lit(0.95), "confidence")).otherwise(F.col("confidence"))
    given = F.coalesce(F.get_json_object("props", "$.disclaimer"), F.when(computed, DISCLAIMER))
    return outputs(spark, d).select("event_id", "tier", F.round(capped, 6).alias("confidence"), given.alias("disclaimer"))


@query("h4_provenance_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents")
def provenance_hash(spark, d):
    """The hash of each whole text, of every length."""
    return read(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("h"))


@query("h5_forbidden_phrases", f"WITH {_ANS} SELECT conv_id, turn, array_to_string(list_filter([{', '.join(repr(p) for p in FORBIDDEN)}], lambda p: contains(lower(answer), p)), ';') AS phrases FROM answers")
def forbidden_phrases(spark, d):
    low = F.lower("answer")
    return answers(spark, d).select("conv_id", "turn", F.array_join(found([(F.contains(low, F.lit(p)), p) for p in FORBIDDEN]), ";").alias("phrases"))


@query("h6_overclaim_scan", f"WITH {_ANS} SELECT conv_id, turn, {_N_OVER} AS n FROM answers")
def overclaim_scan(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.size(overclaims(F.col("answer"))).cast("long").alias("n"))


@query("h7_compliance", f"WITH {_OUT} SELECT event_id, tier_no <> 5 OR k % 4 > 0 AS compliant FROM outputs")
def compliance(spark, d):
    """A tier is there, and a literature row has citations (k mod 4 of them)."""
    return outputs(spark, d).select("event_id", (F.col("tier").isNotNull() & ((F.col("tier_no") != 5) | (F.col("k") % 4 > 0))).alias("compliant"))


@query("h8_tier_summary", f"WITH {_OUT} SELECT t.tier, count(o.event_id)::BIGINT AS n, round(coalesce(avg(o.confidence), 0), 10) AS mean FROM tiers t LEFT JOIN outputs o ON o.tier = t.tier GROUP BY 1")
def tier_summary(spark, d):
    """All five tiers, zero-filled."""
    sums = outputs(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))
    return tiers(spark).join(sums, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), 10).alias("mean"))


_ISSUES = """issues AS (SELECT event_id, 'critical' AS severity, 'literature_citations' AS check_name FROM outputs WHERE tier_no = 5 AND k % 4 = 0
    UNION ALL SELECT event_id, 'critical', 'tier_override' FROM outputs WHERE tier_no = 1 AND expected = 5
    UNION ALL SELECT event_id, 'medium', 'domain_present' FROM outputs WHERE tier_no = 3 AND inside IS NULL
    UNION ALL SELECT event_id, 'high', 'outside_domain_high_confidence' FROM outputs WHERE tier_no = 3 AND NOT inside AND confidence > 0.8
    UNION ALL SELECT event_id, 'medium', 'docking_score_threshold' FROM outputs WHERE tier_no = 2 AND NOT (score <= -5 AND rmsd <= 3) AND NOT (score <= -6 AND rmsd <= 2 AND clashes = 0 AND strain < 5) AND score > -5
    UNION ALL SELECT event_id, 'medium', 'pose_rmsd_quality' FROM outputs WHERE tier_no = 2 AND NOT (score <= -5 AND rmsd <= 3) AND NOT (score <= -6 AND rmsd <= 2 AND clashes = 0 AND strain < 5) AND rmsd > 3
    UNION ALL SELECT event_id, 'high', 'steric_clash' FROM outputs WHERE tier_no = 2 AND NOT (score <= -5 AND rmsd <= 3) AND NOT (score <= -6 AND rmsd <= 2 AND clashes = 0 AND strain < 5) AND clashes > 0
    UNION ALL SELECT event_id, 'medium', 'high_uncertainty' FROM outputs WHERE tier_no = 3 AND confidence < 0.6 AND CASE WHEN k % 7 = 0 THEN 0.2 ELSE k % 10 / 10.0 END > 0.5
    UNION ALL SELECT event_id, 'low', 'confidence_interval_missing' FROM outputs WHERE tier_no = 3 AND (k % 4 = 0 OR k % 6 = 0))"""


def pose_class() -> Column:
    return F.expr("CASE WHEN score <= -6 AND rmsd <= 2 AND clashes = 0 AND strain < 5 THEN 'high' WHEN score <= -5 AND rmsd <= 3 THEN 'medium' ELSE 'low' END")


def issues(spark, d) -> DataFrame:
    """One row per failed check: event_id, severity, check_name. All checks in one pass over the outputs."""
    c = F.col
    low = (c("tier_no") == 2) & (pose_class() == "low")
    rules = [
        (c("tier_no").eqNullSafe(5) & (c("k") % 4 == 0), "critical", "literature_citations"),
        ((c("tier_no") == 1) & (c("expected") == 5), "critical", "tier_override"),
        ((c("tier_no") == 3) & c("inside").isNull(), "medium", "domain_present"),
        ((c("tier_no") == 3) & ~c("inside") & (c("confidence") > 0.8), "high", "outside_domain_high_confidence"),
        (low & (c("score") > -5), "medium", "docking_score_threshold"),
        (low & (c("rmsd") > 3), "medium", "pose_rmsd_quality"),
        (low & (c("clashes") > 0), "high", "steric_clash"),
        # the spread is a tenth of k's last digit, 0.2 where it is missing; a lower or upper bound is missing for every fourth or sixth k
        ((c("tier_no") == 3) & (c("confidence") < 0.6) & (F.when(c("k") % 7 == 0, 0.2).otherwise(c("k") % 10 / 10) > 0.5), "medium", "high_uncertainty"),
        ((c("tier_no") == 3) & ((c("k") % 4 == 0) | (c("k") % 6 == 0)), "low", "confidence_interval_missing"),
    ]
    hits = F.filter(F.array(*(F.when(r, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("check_name"))) for r, s, n in rules)), lambda x: x.isNotNull())
    return outputs(spark, d).select("event_id", F.explode(hits).alias("i")).select("event_id", "i.*")


@query("h9_tier_issues", f"WITH {_OUT}, {_ISSUES} SELECT event_id, severity, check_name FROM issues WHERE check_name IN ('literature_citations', 'tier_override') UNION ALL SELECT NULL, 'critical', 'no_outputs' WHERE (SELECT count(*) FROM outputs) = 0")
def tier_issues(spark, d):
    """Issues of tiers and citations; without any output one critical issue."""
    return with_empty(issues(spark, d).where(F.col("check_name").isin("literature_citations", "tier_override")), outputs(spark, d))


def with_empty(found: DataFrame, given: DataFrame) -> DataFrame:
    """Issues and, if nothing was given to check, a critical one."""
    none = given.agg(F.count("*").alias("n")).where("n = 0")  # one row or none
    return found.select("event_id", "severity", "check_name").unionByName(none.select(F.lit(None).cast("long").alias("event_id"), F.lit("critical").alias("severity"), F.lit("no_outputs").alias("check_name")))


@query("h10_overclaim_issues", f"WITH {_ANS} SELECT conv_id, turn, {_N_OVER} + (conv_id % 5 IN (1, 2, 3) AND regexp_matches(lower(answer), 'clinical efficacy demonstrated|proven to cure|effective treatment for patients'))::BIGINT AS issues FROM answers WHERE {_N_OVER} > 0")
def overclaim_issues(spark, d):
    """Unsafe answers with their number of issues; computational tiers (conv_id mod 5 in 1..3) have one rule more."""
    t = answers(spark, d).withColumn("n", F.size(overclaims(F.col("answer"))).cast("long")).where("n > 0")
    more = (F.col("conv_id") % 5).isin(1, 2, 3) & F.lower("answer").rlike("clinical efficacy demonstrated|proven to cure|effective treatment for patients")
    return t.select("conv_id", "turn", (F.col("n") + more.cast("long")).alias("issues"))


@query("h11_domain_check", f"WITH {_OUT} SELECT count(*)::BIGINT AS total, count(*) FILTER (inside)::BIGINT AS within, count(*) FILTER (inside IS NULL OR NOT inside)::BIGINT AS outside, count(*) FILTER (inside IS NULL)::BIGINT AS missing, count(*) FILTER (NOT inside AND confidence > 0.8)::BIGINT AS high FROM outputs WHERE tier_no = 3")
def domain_check(spark, d):
    """Predictions without a domain count as outside."""
    inside, sure = F.col("inside"), F.col("confidence") > 0.8
    return outputs(spark, d).where("tier_no = 3").agg(F.count("*").alias("total"), F.count_if(inside).alias("within"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"), F.count_if(inside.isNull()).alias("missing"), F.count_if(~inside & sure).alias("high"))


@query("h12_citation_hallucination", f"WITH {_ANS}, c AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(answer || ' [REF_' || (conv_id * 37) || ']', '\\[REF_([0-9]+)\\]', 1)))::BIGINT AS ref FROM answers) SELECT conv_id, turn, count(*)::BIGINT AS cited, count(*) FILTER (doc_id IS NULL)::BIGINT AS invented FROM c LEFT JOIN (SELECT DISTINCT doc_id FROM documents) ON ref = doc_id GROUP BY 1, 2")
def citation_hallucination(spark, d):
    """Cited ids that the corpus lacks. Each answer cites its own number and 37 times that number."""
    text = F.concat("answer", F.lit(" [REF_"), (F.col("conv_id") * 37).cast("string"), F.lit("]"))
    refs = answers(spark, d).select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[REF_([0-9]+)\]"), 1))).alias("ref")).withColumn("ref", F.col("ref").cast("long"))
    known = read(spark, d, "documents").select(F.col("doc_id").alias("ref")).distinct().withColumn("known", F.lit(True))
    return refs.join(known, "ref", "left").groupBy("conv_id", "turn").agg(F.count("*").alias("cited"), F.count_if(F.col("known").isNull()).alias("invented"))


@query("h13_pose_quality", f"WITH {_OUT} SELECT event_id, CASE WHEN score <= -6 AND rmsd <= 2 AND clashes = 0 AND strain < 5 THEN 'high' WHEN score <= -5 AND rmsd <= 3 THEN 'medium' ELSE 'low' END AS quality FROM outputs WHERE tier_no = 2")
def pose_quality(spark, d):
    return outputs(spark, d).where("tier_no = 2").select("event_id", pose_class().alias("quality"))


@query("h14_confidence_bands", f"WITH {_OUT} SELECT tier, count(*) FILTER (confidence >= 0.8)::BIGINT AS high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8)::BIGINT AS medium, count(*) FILTER (confidence < 0.6)::BIGINT AS low, round(avg(confidence), 10) AS mean FROM outputs GROUP BY 1")
def confidence_bands(spark, d):
    c = F.col("confidence")
    return outputs(spark, d).groupBy("tier").agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"), F.round(F.avg(c), 10).alias("mean"))


@query("h15_overall_verdict", f"WITH {_OUT}, {_ISSUES} SELECT check_name, count(*)::BIGINT AS n, count(*) FILTER (severity = 'critical')::BIGINT AS critical, count(*) FILTER (severity = 'critical') = 0 AS valid FROM issues GROUP BY 1")
def overall_verdict(spark, d):
    critical = F.count_if(F.col("severity") == "critical")
    return issues(spark, d).groupBy("check_name").agg(F.count("*").alias("n"), critical.alias("critical"), (critical == 0).alias("valid"))


@query("h16_sanitised_view", "WITH v AS (SELECT user_id, event_type, max_by(props, row(ts, event_id)) AS props FROM events GROUP BY 1, 2) SELECT event_type || '_' || user_id AS key, substr(props, 1, 500) AS content FROM v")
def sanitised_view(spark, d):
    """The last output of each tier and candidate, cut at 500 characters."""
    last = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("props", F.struct("ts", "event_id")).alias("props"))
    return last.select(F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("key"), F.substring("props", 1, 500).alias("content"))


@query("h17_issue_rows", f"WITH {_OUT}, {_ISSUES} SELECT severity, check_name, check_name || ' failed for output ' || event_id AS message FROM issues")
def issue_rows(spark, d):
    return issues(spark, d).select("severity", "check_name", F.concat("check_name", F.lit(" failed for output "), F.col("event_id").cast("string")).alias("message"))


@query("h18_sanitised_answers", f"WITH {_ANS} SELECT conv_id, turn, CASE WHEN {_N_OVER} > 0 THEN answer || ' [hypothesis only]' ELSE answer END AS answer FROM answers")
def sanitised_answers(spark, d):
    """Flagged answers get a disclaimer."""
    flagged = F.size(overclaims(F.col("answer"))) > 0
    return answers(spark, d).select("conv_id", "turn", F.when(flagged, F.concat("answer", F.lit(" [hypothesis only]"))).otherwise(F.col("answer")).alias("answer"))


@query("h19_disclaimer_level", f"WITH {_OUT} SELECT user_id, CASE WHEN bool_or(tier_no IN (2, 3)) THEN 'computational' WHEN bool_or(tier_no = 4) THEN 'interpretation' ELSE 'record' END AS level FROM outputs GROUP BY 1")
def disclaimer_level(spark, d):
    seen = outputs(spark, d).groupBy("user_id").agg(F.bool_or(F.col("tier_no").isin(2, 3)).alias("a"), F.bool_or(F.col("tier_no") == 4).alias("b"))
    return seen.select("user_id", F.when(F.col("a"), "computational").when(F.col("b"), "interpretation").otherwise("record").alias("level"))


@query("h20_candidate_evidence", f"WITH {_OUT} SELECT user_id, count(DISTINCT tier)::BIGINT AS tiers, round(min(score) FILTER (tier_no = 2), 4) AS docking, round(max(confidence) FILTER (tier_no = 3), 6) AS model, NULL::DOUBLE AS composite FROM outputs GROUP BY 1")
def candidate_evidence(spark, d):
    """The composite of unlike evidence is never computed."""
    of = lambda n, c: F.when(F.col("tier_no") == n, F.col(c))
    return outputs(spark, d).groupBy("user_id").agg(F.count_distinct("tier").alias("tiers"), F.round(F.min(of(2, "score")), 4).alias("docking"), F.round(F.max(of(3, "confidence")), 6).alias("model"), F.lit(None).cast("double").alias("composite"))


# ---- ranking and reports


@query("i1_candidate_keys", "SELECT event_id, coalesce(props::JSON ->> '$.compound_id', props::JSON ->> '$.compound_name', props::JSON ->> '$.smiles', CASE WHEN user_id % 10 <> 0 THEN user_id::VARCHAR END, 'unknown') AS candidate FROM events")
def candidate_keys(spark, d):
    at = lambda p: F.get_json_object("props", f"$.{p}")
    user = F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string"))
    return read(spark, d, "events").select("event_id", F.coalesce(at("compound_id"), at("compound_name"), at("smiles"), user, F.lit("unknown")).alias("candidate"))


@query("i2_candidate_tiers", f"WITH {_OUT}, g AS (SELECT user_id, tier, count(*)::BIGINT AS n, round(avg(confidence), 10) AS mean FROM outputs GROUP BY 1, 2), f AS (SELECT user_id, tier, string_agg(event_id::VARCHAR, ';' ORDER BY event_id) AS first_outputs FROM (SELECT *, row_number() OVER (PARTITION BY user_id, tier ORDER BY event_id) AS nth FROM outputs) WHERE nth <= 5 GROUP BY 1, 2) SELECT user_id, coalesce(c_name, 'candidate ' || user_id) AS name, tier, n, mean, first_outputs FROM g JOIN f USING (user_id, tier) LEFT JOIN customer ON c_custkey = user_id")
def candidate_tiers(spark, d):
    """Outputs of each candidate and tier: number, mean confidence, the first five; named where the catalogue knows the key."""
    t = outputs(spark, d).select("user_id", "tier", "event_id", "confidence")
    nth = F.row_number().over(Window.partitionBy("user_id", "tier").orderBy("event_id"))
    first = t.withColumn("nth", nth).where("nth <= 5").groupBy("user_id", "tier").agg(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ";").alias("first_outputs"))
    g = t.groupBy("user_id", "tier").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 10).alias("mean")).join(first, ["user_id", "tier"])
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return g.join(names, "user_id", "left").select("user_id", F.coalesce("c_name", F.concat(F.lit("candidate "), F.col("user_id").cast("string"))).alias("name"), "tier", "n", "mean", "first_outputs")


_RANK = """m AS (SELECT user_id, tier_no, any_value(weight) * avg(confidence) AS c, count(*) AS n, min(score) AS s, bool_and(coalesce(inside, true)) AS i FROM outputs GROUP BY 1, 2),
    b AS (SELECT user_id, sum(c) AS raw, sum(n)::BIGINT AS outputs, min(s) FILTER (tier_no = 2) AS best, bool_and(i) FILTER (tier_no = 3) AS inside FROM m GROUP BY 1),
    ranked AS (SELECT user_id, outputs, best, raw * CASE WHEN best <= -8 THEN 1.2 WHEN best <= -7 THEN 1.1 WHEN best > -5 THEN 0.7 ELSE 1.0 END::DOUBLE * CASE WHEN inside = false THEN 0.6 ELSE 1.0 END::DOUBLE AS score FROM b)"""


def priorities(spark, d) -> DataFrame:
    """Sum of tier weight times mean confidence, times the docking and the domain factor, per candidate."""
    m = outputs(spark, d).groupBy("user_id", "tier_no").agg((F.first("weight") * F.avg("confidence")).alias("c"), F.count("*").alias("n"), F.min("score").alias("s"), F.bool_and(F.coalesce("inside", F.lit(True))).alias("i"))
    of = lambda n, c: F.when(F.col("tier_no") == n, F.col(c))
    b = m.groupBy("user_id").agg(F.sum("c").alias("raw"), F.sum("n").alias("outputs"), F.min(of(2, "s")).alias("best"), F.bool_and(of(3, "i")).alias("inside"))
    docking = F.when(F.col("best") <= -8, 1.2).when(F.col("best") <= -7, 1.1).when(F.col("best") > -5, 0.7).otherwise(1.0)
    return b.select("user_id", "outputs", "best", (F.col("raw") * docking * F.when(~F.col("inside"), 0.6).otherwise(1.0)).alias("score"))


@query("i3_priority_ranking", f"WITH {_OUT}, {_RANK} SELECT user_id, round(score, 6) AS score, outputs FROM ranked")
def priority_ranking(spark, d):
    return priorities(spark, d).select("user_id", F.round("score", 6).alias("score"), "outputs")


def numbered(top: DataFrame, *order: Column) -> DataFrame:
    """Ranks 1.. for an already limited frame, without a window over one partition of everything."""
    key = F.struct(*order, F.struct(*top.columns).alias("row_"))
    rows = top.groupBy().agg(F.array_sort(F.collect_list(key)).alias("r")).select(F.posexplode("r").alias("i", "r"))
    return rows.select("r.row_.*", (F.col("i") + 1).cast("long").alias("rank"))


@query("i4_ranked_candidates", f"WITH {_OUT}, {_RANK}, r AS (SELECT user_id, round(score, 6) AS score FROM ranked ORDER BY 2 DESC, 1 LIMIT 20) SELECT *, row_number() OVER (ORDER BY score DESC, user_id)::BIGINT AS rank FROM r")
def ranked_candidates(spark, d):
    """The twenty best candidates; rows without a known candidate only count if there are no others."""
    top = known_candidates(priority_ranking(spark, d).select("user_id", "score"), "user_id").orderBy(F.desc("score"), "user_id").limit(20)
    return numbered(top, (-F.col("score")).alias("a"), F.col("user_id").alias("b"))


def known_candidates(t: DataFrame, key: str) -> DataFrame:
    """t without the rows whose key is null, unless there are no others."""
    known = t.agg(F.count(key).alias("known_"))  # one row
    return t.crossJoin(F.broadcast(known)).where(F.col(key).isNotNull() | (F.col("known_") == 0)).drop("known_")


@query("i5_display_fields", f"WITH {_OUT} SELECT user_id, min_by(k, row(tier_no, event_id)) FILTER (k % 4 <> 0) AS shown FROM outputs GROUP BY 1")
def display_fields(spark, d):
    """The first field that is there, in tier order."""
    k = F.when(F.col("k") % 4 != 0, F.col("k"))
    return outputs(spark, d).groupBy("user_id").agg(F.min_by("k", F.when(k.isNotNull(), F.struct("tier_no", "event_id"))).alias("shown"))


@query("i6_outputs_by_tier", f"WITH {_OUT} SELECT tier, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS candidates FROM outputs GROUP BY 1")
def outputs_by_tier(spark, d):
    return outputs(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("candidates"))


@query("i9_resorted", f"WITH {_OUT}, {_RANK} SELECT user_id, round(coalesce(best, 0), 4) AS best FROM ranked ORDER BY 2, 1 LIMIT 50")
def resorted(spark, d):
    """Candidates by best docking score, none as 0."""
    return priorities(spark, d).select("user_id", F.round(F.coalesce("best", F.lit(0.0)), 4).alias("best")).orderBy("best", "user_id").limit(50)


@query("i11_merged_branches", "SELECT user_id, event_type, props AS content FROM events WHERE value > 20 UNION SELECT user_id, event_type, props FROM events WHERE value < 60")
def merged_branches(spark, d):
    """The union of two branches, rows of equal content once; the whole content counts."""
    t = read(spark, d, "events")
    branch = lambda w: t.where(w).select("user_id", "event_type", F.col("props").alias("content"))
    return branch("value > 20").unionByName(branch("value < 60")).distinct()
