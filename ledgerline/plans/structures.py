"""Structure-string features and rule verdicts. The structure string s is name|type|key of `part`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.descriptors import byte_hashes, clamp, count_of, heavy_atoms, uniform, with_descriptors
from ledgerline.registry import query
from ledgerline.sources.tables import read

#: Names of the alerts and their patterns (first table, then the second).
ALERTS = (
    ("hzone_phenol_A(479)", "Oc1ccccc1"),
    ("quinone_A(370)", "O=C1C=CC(=O)C=C1"),
    ("catechol_A(92)", "Oc1ccccc1O"),
    ("rhodanine(0)", "S=C1NC(=O)CS1"),
    ("ene_five_het_A(21)", "NNC=O"),
    ("imine_one_isatin(0)", "O=C1Cc2ccccc2N1"),
    ("imine_one_imine(0)", "C=NN"),
    ("phenol", "c1ccccc1O"),
    ("michael_acceptor_1", "C=CC(=O)[OH]"),
    ("michael_acceptor_2", "C=CC(=O)C"),
    ("alkyl_halide", "C[Cl,Br,I]"),
    ("epoxide", "C1OC1"),
    ("thiol", "[SH]"),
    ("aldehyde", "C(=O)[H]"),
    ("azo_A(324)", "N=N"),
    ("anil_di_alk_A(89)", "c1ccc(N(C)C)cc1"),
    ("phosphor", "[P]"),
    ("epoxide", "C1OC1"),
    ("azide", "[N-]=[N+]=[N-]"),
    ("thiol", "[SH]"),
    ("halogen_unsaturated", "C=C[Br,I,Cl,F]"),
)
_S = "(p_name || '|' || p_type || '|' || p_partkey::VARCHAR)"
_ALERTED = "(contains(s, 'S=C') OR contains(s, 'C1OC1') OR (contains(s, 'c1ccccc1') AND len(regexp_extract_all(s, 'O')) >= 2))"


def _u(seed, low, high):
    return f"({float(low)}::DOUBLE + (CAST('0x' || substr(md5(s || '_{seed}'), 1, 8) AS BIGINT) % 1000000) / 1000000.0::DOUBLE * {float(high) - float(low)}::DOUBLE)"


def _n(p):
    return f"len(regexp_extract_all(s, '{p}'))::BIGINT"


_BASE = f"""a AS (SELECT p_partkey, {_S} AS s FROM part), b AS (SELECT *, {_n('[Cc]')} AS c_, {_n('[Nn]')} AS n_, {_n('[Oo]')} AS o_, {_n('[Ss]')} AS s_, {_n('F')} + {_n('Cl')} + {_n('Br')} + {_n('I')} AS hal_,
    greatest(1, len(list_filter(regexp_extract_all(s, '\\[.*?\\]|Br|Cl|[A-Z][a-z]?|[a-z]'), lambda t: regexp_replace(t, '[\\[\\]]', '', 'g') NOT IN ('H', 'h'))))::BIGINT AS heavy FROM a),
    c AS (SELECT *, greatest(60.0, 12.011 * c_ + 14.007 * n_ + 15.999 * o_ + 32.06 * s_ + 19 * hal_ + {_u(1, -15, 15)} + 1.5 * heavy)::DOUBLE AS mw,
    least(10, greatest(-5, (0.3 * c_ - o_ - 0.8 * n_ - 0.2 * s_)::DOUBLE / 3 + {_u(2, -1.5, 1.5)})) AS logp, floor(0.4 * {_n('[ON]')} + {_u(3, 0, 3)})::BIGINT AS hbd, floor(0.6 * (o_ + n_) + {_u(4, 0, 4)})::BIGINT AS hba,
    least(300, greatest(0, 17 * o_ + 13 * n_ + 5 * s_ + {_u(5, 0, 20)})) AS tpsa, floor(least(20, greatest(0, {_n('-')} + c_ // 4 + {_u(6, 0, 4)})))::BIGINT AS rot,
    least(7, {_n('[0-9]')} // 2 + floor({_u(7, 0, 2)})::BIGINT)::BIGINT AS rings, least(1, greatest(0, {_n('C')}::DOUBLE / greatest(1, c_) + {_u(9, -0.1, 0.1)})) AS csp3, 1 + {_u(11, 0, 3)} AS balaban, {_u(13, 0.2, 0.9)} AS qed,
    (n_ + o_ + s_ > 0)::BIGINT AS het, {_n('C\\(=O\\)N')} + {_n('C\\(=O\\)NC')} AS amide FROM b),
    d AS (SELECT *, least(rings, ({_n('c')} + {_n('n')} // 2 + {_n('o')} // 4) // 4 + floor({_u(8, 0, 2)})::BIGINT)::BIGINT AS arom, 15 * heavy + 25 * rings + {_u(10, 0, 500)} AS bertz, mw / 4 + {_u(12, -5, 5)} AS mr FROM c)"""


def structures(spark, d) -> DataFrame:
    return read(spark, d, "part").withColumn("s", F.concat_ws("|", "p_name", "p_type", F.col("p_partkey").cast("string")))


def described(spark, d) -> DataFrame:
    return with_descriptors(structures(spark, d).select("p_partkey", "s"))


def lipinski_broken() -> Column:
    c = F.col
    return sum(((c(k) > v).cast("long") for k, v in (("logp", 5), ("hbd", 5), ("hba", 10))), (c("mw") > 500).cast("long"))


def rules() -> dict[str, Column]:
    """The five drug-likeness filters."""
    c = F.col
    return {
        "lipinski": lipinski_broken() <= 1,
        "veber": (c("rot") <= 10) & ((c("tpsa") <= 140) | (c("hbd") + c("hba") <= 12)),
        "ghose": c("mw").between(160, 480) & c("logp").between(-0.4, 5.6) & c("mr").between(40, 130) & c("heavy").between(20, 70),
        "egan": c("logp").between(-1, 5.88) & (c("tpsa") <= 131.6),
        "qed_ok": c("qed") >= 0.4,
    }


_RULES = """((mw > 500)::BIGINT + (logp > 5)::BIGINT + (hbd > 5)::BIGINT + (hba > 10)::BIGINT) AS broken, rot <= 10 AND (tpsa <= 140 OR hbd + hba <= 12) AS veber,
    mw BETWEEN 160 AND 480 AND logp BETWEEN -0.4 AND 5.6 AND mr BETWEEN 40 AND 130 AND heavy BETWEEN 20 AND 70 AS ghose, logp BETWEEN -1 AND 5.88 AND tpsa <= 131.6 AS egan, qed >= 0.4 AS qed_ok"""
_VERDICT = f"""r AS (SELECT *, {_RULES} FROM d), v AS (SELECT *, (broken <= 1) AS lipinski, (broken <= 1)::BIGINT + veber::BIGINT + ghose::BIGINT + egan::BIGINT + qed_ok::BIGINT AS passed FROM r),
    w AS (SELECT *, CASE WHEN {_ALERTED} THEN 'FAIL_PAINS' WHEN passed >= 4 THEN 'PASS' WHEN passed >= 2 THEN 'MODERATE - NATURAL_PRODUCT_TOLERATED' ELSE 'LOW - REQUIRES_OPTIMIZATION' END AS verdict FROM v)"""


@query("c1_structure_validity", f"""SELECT p_partkey, CASE WHEN length({_S}) = 0 THEN 'empty' WHEN length({_S}) > 10000 THEN 'too long' WHEN NOT regexp_matches({_S}, '[A-Z\\[]') THEN 'no element'
    WHEN length(regexp_replace({_S}, '[^(]', '', 'g')) <> length(regexp_replace({_S}, '[^)]', '', 'g')) THEN 'unbalanced' WHEN regexp_matches({_S}, '[{{}}<>]') THEN 'alphabet' ELSE 'ok' END AS verdict FROM part""")
def structure_validity(spark, d):
    s = F.col("s")
    even = (count_of(s, r"\(") == count_of(s, r"\)")) & (count_of(s, r"\[") == count_of(s, r"\]"))
    verdict = F.when(F.length(s) == 0, "empty").when(F.length(s) > 10000, "too long").when(~s.rlike(r"[A-Z\[]"), "no element").when(~even, "unbalanced").when(s.rlike("[{}<>]"), "alphabet").otherwise("ok")
    return structures(spark, d).select("p_partkey", verdict.alias("verdict"))


@query("c2_hash_features", f"WITH a AS (SELECT p_partkey, {_S} AS s FROM part) SELECT p_partkey, round({_u('mw', 100, 500)}, 6) AS u, round(CAST('0x' || substr(md5(s), 7, 2) AS BIGINT) / 255.0::DOUBLE, 6) AS h3 FROM a")
def hash_features(spark, d):
    s = F.col("s")
    return structures(spark, d).select("p_partkey", F.round(uniform(s, "mw", 100, 500), 6).alias("u"), F.round(byte_hashes(s, 18)[3], 6).alias("h3"))


@query("c3_heavy_atoms", f"WITH {_BASE} SELECT p_partkey, heavy FROM b")
def heavy_atom_counts(spark, d):
    return structures(spark, d).select("p_partkey", heavy_atoms(F.trim("s")).alias("heavy"))


_ROUNDED = ("mw", "logp", "tpsa", "csp3", "bertz", "balaban", "mr", "qed")
_WHOLE = ("heavy", "hbd", "hba", "rot", "rings", "arom", "het", "amide")


@query("c4_descriptors", f"WITH {_BASE} SELECT p_partkey, {', '.join(f'round({c}, 8) AS {c}' for c in _ROUNDED)}, {', '.join(_WHOLE)}, rings - arom AS aliphatic, 0::BIGINT AS charge, 0::BIGINT AS radicals, 'expressions' AS source FROM d")
def descriptors(spark, d):
    zero = F.lit(0).cast("long")
    return described(spark, d).select("p_partkey", *(F.round(c, 8).alias(c) for c in _ROUNDED), *_WHOLE, "aliphatic", zero.alias("charge"), zero.alias("radicals"), F.lit("expressions").alias("source"))


def _h(i):
    return f"(CAST('0x' || substr(md5(s), {2 * i + 1}, 2) AS BIGINT) / 255.0::DOUBLE)" if i < 16 else "0.5::DOUBLE"


_QSAR = f"""a AS (SELECT p_partkey, {_S} AS s FROM part), q AS (SELECT p_partkey, s, greatest(1, {_n('[A-Z][a-z]?|c|n|o|s')})::BIGINT AS heavy FROM a), qsar AS (SELECT p_partkey, s, heavy, greatest(100, 13 * heavy + {_n('C')} + 100 * ({_h(0)} - 0.5))::DOUBLE AS mw,
    least(8, greatest(-3, ({_n('C')} - 1.5 * {_n('O')} - {_n('N')})::DOUBLE / 5 + 1 + 2 * ({_h(1)} - 0.5)))::DOUBLE AS logp, least(12, floor(0.5 * {_n('[ON]')} + 3 * {_h(2)}))::BIGINT AS hbd, least(15, floor(0.6 * {_n('[ONF]')} + 4 * {_h(3)}))::BIGINT AS hba, 20 + 120 * {_h(4)} AS tpsa,
    least(15, floor({_n('-')} + {_n('C-C')} + 6 * {_h(5)}))::BIGINT AS rot, least(6, {_n('[0-9]')} // 2 + floor(2 * {_h(6)}))::BIGINT AS rings, least(4, floor(4 * {_h(7)}))::BIGINT AS arom, {_h(8)} AS csp3, floor(3 * {_h(9)})::BIGINT AS aliphatic, floor(3 * {_h(10)})::BIGINT AS het,
    trunc(2 * ({_h(11)} - 0.5))::BIGINT AS charge, 100 + 800 * {_h(0)} AS bertz, 1 + 3 * {_h(1)} AS balaban, 10 + 8 * {_h(12)} AS bcut, least(0.95, greatest(0.1, 0.3 + 0.6 * {_h(13)})) AS qed FROM q)"""


def qsar(t: DataFrame) -> DataFrame:
    """The eighteen model features of a structure string s, with formulas of their own."""
    s, c = F.col("s"), F.col
    n = lambda p: count_of(s, p)
    t = t.withColumns({"h_": byte_hashes(s, 18), "heavy": F.greatest(F.lit(1).cast("long"), n("[A-Z][a-z]?|c|n|o|s"))})
    h = lambda i: c("h_")[i]
    return t.withColumns(
        {
            "mw": F.greatest(F.lit(100.0), 13 * c("heavy") + n("C") + 100 * (h(0) - 0.5)),
            "logp": clamp((n("C") - 1.5 * n("O") - n("N")) / 5 + 1 + 2 * (h(1) - 0.5), -3, 8),
            "hbd": F.least(F.lit(12), F.floor(0.5 * n("[ON]") + 3 * h(2))).cast("long"),
            "hba": F.least(F.lit(15), F.floor(6 * n("[ONF]") / 10 + 4 * h(3))).cast("long"),
            "tpsa": 20 + 120 * h(4),
            "rot": F.least(F.lit(15), F.floor(n("-") + n("C-C") + 6 * h(5))).cast("long"),
            "rings": F.least(F.lit(6), F.floor(n("[0-9]") / 2) + F.floor(2 * h(6))).cast("long"),
            "arom": F.least(F.lit(4), F.floor(4 * h(7))).cast("long"),
            "csp3": h(8),
            "aliphatic": F.floor(3 * h(9)),
            "het": F.floor(3 * h(10)),
            "charge": (2 * (h(11) - 0.5)).cast("long"),
            "bertz": 100 + 800 * h(0),
            "balaban": 1 + 3 * h(1),
            "bcut": 10 + 8 * h(12),
            "qed": clamp(0.3 + 0.6 * h(13), 0.1, 0.95),
        }
    ).drop("h_")


_QR, _QW = ("mw", "logp", "tpsa", "csp3", "bertz", "balaban", "bcut", "qed"), ("heavy", "hbd", "hba", "rot", "rings", "arom", "aliphatic", "het", "charge")


@query("c5_qsar_features", f"WITH {_QSAR} SELECT p_partkey, {', '.join(f'round({c}, 5) AS {c}' for c in _QR)}, {', '.join(_QW)} FROM qsar")
def qsar_features(spark, d):
    return qsar(structures(spark, d).select("p_partkey", "s")).select("p_partkey", *(F.round(c, 5).alias(c) for c in _QR), *_QW)


_LIG = f"""a AS (SELECT p_partkey, {_S} AS s FROM part), lig AS (SELECT p_partkey, least(100 + 12 * length(s), 900)::DOUBLE AS mw, least(8, greatest(-3, 0.3 * {_n('C')} - 0.5 * {_n('O')}))::DOUBLE AS logp, least({_n('O')} // 2 + {_n('N')}, 10)::BIGINT AS hbd,
    least({_n('[ON]')}, 15)::BIGINT AS hba, least(greatest(1, {_n('C')} // 3), 20)::BIGINT AS rot, least(12 * {_n('[ON]')} + 15 * ({_n('O')} // 2 + {_n('N')}), 200)::DOUBLE AS tpsa, greatest({_n('[A-Z]')}, 5)::BIGINT AS heavy, least({_n('c')} // 5 + {_n('C1')}, 8)::BIGINT AS arom FROM a)"""


def ligand(t: DataFrame) -> DataFrame:
    """The ligand features of a structure string s that scoring uses."""
    s = F.col("s")
    n = lambda p: count_of(s, p)
    whole = lambda c, most: F.least(F.lit(most), c).cast("long")
    donors = F.floor(n("O") / 2) + n("N")
    return t.withColumns(
        {
            "mw": F.least(100 + 12 * F.length(s), F.lit(900)).cast("double"),
            "logp": clamp(0.3 * n("C") - 0.5 * n("O"), -3, 8),
            "hbd": whole(donors, 10),
            "hba": whole(n("[ON]"), 15),
            "rot": whole(F.greatest(F.lit(1).cast("long"), F.floor(n("C") / 3)), 20),
            "tpsa": F.least(12 * n("[ON]") + 15 * donors, F.lit(200)).cast("double"),
            "heavy": F.greatest(n("[A-Z]"), F.lit(5)).cast("long"),
            "arom": whole(F.floor(n("c") / 5) + n("C1"), 8),
        }
    )


@query("c6_ligand_vector", f"WITH {_LIG} SELECT p_partkey, round(mw / 500, 6) AS v0, round(logp, 6) AS v1, hbd, hba, round(rot / 10.0, 6) AS v4, round(tpsa / 100, 6) AS v5, round(heavy / 50.0, 6) AS v6, arom, 0::BIGINT AS charge FROM lig")
def ligand_vector(spark, d):
    c = F.col
    t = ligand(structures(spark, d).select("p_partkey", "s"))
    return t.select("p_partkey", F.round(c("mw") / 500, 6).alias("v0"), F.round("logp", 6).alias("v1"), "hbd", "hba", F.round(c("rot") / 10, 6).alias("v4"), F.round(c("tpsa") / 100, 6).alias("v5"), F.round(c("heavy") / 50, 6).alias("v6"), "arom", F.lit(0).cast("long").alias("charge"))


_L = "lower(s)"
_CLASS = f"""a AS (SELECT p_partkey, {_S} AS s, len(string_split(p_name, ' ')) AS uses FROM part), x AS (SELECT p_partkey, uses, s, CASE WHEN contains({_L}, 'n') THEN 0.6 + 0.4 * {_h(1)} ELSE 0.7 * {_h(1)} END AS alkaloid,
    CASE WHEN len(regexp_extract_all({_L}, 'c')) >= 10 THEN 0.5 + 0.5 * {_h(2)} ELSE 0.7 * {_h(2)} END AS terpenoid FROM a)"""


_FLAGS = f"""SELECT p_partkey, 1::BIGINT AS flavonoid, (alkaloid > 0.6)::BIGINT AS alkaloid, (terpenoid > 0.6)::BIGINT AS terpenoid, (0.7 * {_h(3)} > 0.6)::BIGINT AS phenolic, (0.7 * {_h(4)} > 0.6)::BIGINT AS saponin, (0.7 * {_h(5)} > 0.6)::BIGINT AS tannin,
    (contains(s, 'C=CC(=O)') OR contains(s, 'OC1C') OR {_h(0)} > 0.75)::BIGINT AS privileged, round(least(1, uses / 5.0 + 0.3 * {_h(1)}), 6) AS use_score, ({_h(2)} < 0.33)::BIGINT AS a, ({_h(2)} >= 0.33 AND {_h(2)} < 0.66)::BIGINT AS b, ({_h(2)} >= 0.66)::BIGINT AS c FROM x"""


@query("c7_class_flags", f"WITH {_CLASS} {_FLAGS}")
def class_flags(spark, d):
    """Six class flags (the first is always set), the privileged flag, the use score and three one-of flags."""
    return flags(structures(spark, d))


def flags(t: DataFrame) -> DataFrame:
    """The eleven class columns of t(p_partkey, p_name, s)."""
    s, low = F.col("s"), F.lower("s")
    t = t.withColumn("h", byte_hashes(F.col("s"), 6))
    h = lambda i: F.col("h")[i]
    scores = {
        "alkaloid": F.when(F.contains(low, F.lit("n")), 0.6 + 0.4 * h(1)).otherwise(0.7 * h(1)),
        "terpenoid": F.when(count_of(low, "c") >= 10, 0.5 + 0.5 * h(2)).otherwise(0.7 * h(2)),
        "phenolic": 0.7 * h(3),
        "saponin": 0.7 * h(4),
        "tannin": 0.7 * h(5),
    }
    flag = lambda c, name: c.cast("long").alias(name)
    privileged = F.contains(s, F.lit("C=CC(=O)")) | F.contains(s, F.lit("OC1C")) | (h(0) > 0.75)
    use = F.least(F.lit(1.0), F.size(F.split("p_name", " ")) / F.lit(5.0) + 0.3 * h(1))
    return t.select("p_partkey", F.lit(1).cast("long").alias("flavonoid"), *(flag(c > 0.6, n) for n, c in scores.items()), flag(privileged, "privileged"), F.round(use, 6).alias("use_score"), flag(h(2) < 0.33, "a"), flag((h(2) >= 0.33) & (h(2) < 0.66), "b"), flag(h(2) >= 0.66, "c"))


def alert_rule(s: Column, pattern: Column) -> Column:
    """Whether a structure string holds what the pattern of an alert stands for, by rules that need no chemistry library."""
    return (
        (F.contains(pattern, F.lit("S=C1NC")) & F.contains(s, F.lit("S=C")))
        | ((pattern == "Oc1ccccc1O") & (count_of(s, "O") >= 2) & F.contains(s, F.lit("c1ccccc1")))
        | ((pattern == "C1OC1") & F.contains(s, F.lit("C1OC1")))
    )


def alert_names(s: Column) -> Column:
    """The alerts of a structure string, in the order of their table."""
    return F.filter(F.array(*(F.when(alert_rule(s, F.lit(p)), F.lit(n)) for n, p in ALERTS)), lambda x: x.isNotNull())


@query("c8_alerts", f"WITH x AS (SELECT p_partkey, {_S} AS s FROM part) SELECT p_partkey, concat_ws(';', CASE WHEN contains(s, 'c1ccccc1') AND len(regexp_extract_all(s, 'O')) >= 2 THEN 'catechol_A(92)' END, CASE WHEN contains(s, 'S=C') THEN 'rhodanine(0)' END, CASE WHEN contains(s, 'C1OC1') THEN 'epoxide;epoxide' END) AS alerts FROM x")
def alerts(spark, d):
    """Alerts of each whole structure string; rows without stay. One projection, no join with the pattern table."""
    return structures(spark, d).select("p_partkey", F.array_join(alert_names(F.col("s")), ";").alias("alerts"))


@query("c9_lipinski", f"WITH {_BASE}, {_VERDICT} SELECT p_partkey, broken AS violations, lipinski AS passes, broken = 0 AS strict FROM w")
def lipinski(spark, d):
    return described(spark, d).select("p_partkey", lipinski_broken().alias("violations"), (lipinski_broken() <= 1).alias("passes"), (lipinski_broken() == 0).alias("strict"))


@query("c10_c12_rules", f"WITH {_BASE}, {_VERDICT} SELECT p_partkey, veber, ghose, egan FROM w")
def shape_rules(spark, d):
    return described(spark, d).select("p_partkey", *(rules()[n].alias(n) for n in ("veber", "ghose", "egan")))


@query("c13_score_bands", f"WITH {_BASE} SELECT CASE WHEN qed >= 0.67 THEN 'attractive' WHEN qed >= 0.5 THEN 'strict' WHEN qed >= 0.4 THEN 'pass' WHEN qed >= 0.3 THEN 'low' ELSE 'unattractive' END AS band, count(*)::BIGINT AS n, round(avg(qed), 6) AS mean FROM d GROUP BY 1")
def score_bands(spark, d):
    q = F.col("qed")
    band = F.when(q >= 0.67, "attractive").when(q >= 0.5, "strict").when(q >= 0.4, "pass").when(q >= 0.3, "low").otherwise("unattractive")
    return described(spark, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"))


@query("c14_admet", f"""WITH {_BASE} SELECT p_partkey, logp BETWEEN 1 AND 5 AND mw < 400 AND tpsa < 90 AND hbd < 3 AS bbb, tpsa < 140 AND mw < 500 AND rot < 10 AND logp < 5 AS gi, mw BETWEEN 250 AND 350 AND logp <= 3.5 AND rot <= 7 AS lead_like,
    CASE WHEN logp < 1 THEN 'high' WHEN logp < 3 THEN 'moderate' WHEN logp < 5 THEN 'low' ELSE 'very low' END AS solubility FROM d""")
def admet(spark, d):
    c = F.col
    bbb = c("logp").between(1, 5) & (c("mw") < 400) & (c("tpsa") < 90) & (c("hbd") < 3)
    gi = (c("tpsa") < 140) & (c("mw") < 500) & (c("rot") < 10) & (c("logp") < 5)
    lead = c("mw").between(250, 350) & (c("logp") <= 3.5) & (c("rot") <= 7)
    soluble = F.when(c("logp") < 1, "high").when(c("logp") < 3, "moderate").when(c("logp") < 5, "low").otherwise("very low")
    return described(spark, d).select("p_partkey", bbb.alias("bbb"), gi.alias("gi"), lead.alias("lead_like"), soluble.alias("solubility"))


def assessed(spark, d) -> DataFrame:
    """Descriptors with the number of filters passed and the verdict; an alert of the structure string overrides."""
    passed = sum((c.cast("long") for c in rules().values()), F.lit(0).cast("long"))
    verdict = F.when(F.size(alert_names(F.col("s"))) > 0, "FAIL_PAINS").when(F.col("passed") >= 4, "PASS").when(F.col("passed") >= 2, "MODERATE - NATURAL_PRODUCT_TOLERATED").otherwise("LOW - REQUIRES_OPTIMIZATION")
    return described(spark, d).withColumn("passed", passed).withColumn("verdict", verdict)


@query("c15_verdict", f"WITH {_BASE}, {_VERDICT} SELECT p_partkey, passed, verdict FROM w")
def verdicts(spark, d):
    return assessed(spark, d).select("p_partkey", "passed", "verdict")


@query("c16_batch_summary", f"WITH {_BASE}, {_VERDICT} SELECT count(*)::BIGINT AS total, count(*) FILTER (length(s) = 0 OR length(regexp_replace(s, '[^(]', '', 'g')) <> length(regexp_replace(s, '[^)]', '', 'g')))::BIGINT AS failed, count(*) FILTER (lipinski OR verdict = 'PASS')::BIGINT AS lipinski, count(*) FILTER (veber)::BIGINT AS veber, round(avg(qed), 6) AS mean, round(min(qed), 6) AS low, round(max(qed), 6) AS high FROM w")
def batch_summary(spark, d):
    r = rules()
    return assessed(spark, d).agg(F.count("*").alias("total"), F.count_if(structure_error(F.col("s")).isNotNull()).alias("failed"), F.count_if(r["lipinski"] | (F.col("verdict") == "PASS")).alias("lipinski"), F.count_if(r["veber"]).alias("veber"), F.round(F.avg("qed"), 6).alias("mean"), F.round(F.min("qed"), 6).alias("low"), F.round(F.max("qed"), 6).alias("high"))


def structure_error(s: Column) -> Column:
    """Why a structure string cannot be described, or null."""
    return F.when(s.isNull() | (s == ""), "no structure").when(count_of(s, r"\(") != count_of(s, r"\)"), "invalid")


def described_or_failed(t: DataFrame) -> DataFrame:
    """t(p_partkey, s) with `error` and `mw`: failing rows stay, with an error and without descriptors."""
    t = t.withColumn("error", structure_error(F.col("s"))).select("p_partkey", "error", F.coalesce("s", F.lit("")).alias("s"))
    return with_descriptors(t).select("p_partkey", "error", F.when(F.col("error").isNull(), F.round("mw", 8)).alias("mw"))


@query("c17_rows_with_errors", f"WITH {_BASE} SELECT p_partkey, CASE WHEN s = '' THEN 'no structure' WHEN length(regexp_replace(s, '[^(]', '', 'g')) <> length(regexp_replace(s, '[^)]', '', 'g')) THEN 'invalid' END AS error, CASE WHEN s <> '' AND length(regexp_replace(s, '[^(]', '', 'g')) = length(regexp_replace(s, '[^)]', '', 'g')) THEN round(mw, 8) END AS mw FROM d")
def rows_with_errors(spark, d):
    return described_or_failed(structures(spark, d).select("p_partkey", "s"))


@query("c18_stored_filter", f"WITH {_BASE}, {_VERDICT} SELECT p_partkey FROM w WHERE qed > 0.5 AND broken <= 1")
def stored_filter(spark, d):
    t = described(spark, d).select("p_partkey", F.struct(F.col("qed").alias("qed_score"), lipinski_broken().alias("violations")).alias("drug_likeness"))
    return t.where("drug_likeness.qed_score > 0.5 AND drug_likeness.violations <= 1").select("p_partkey")
