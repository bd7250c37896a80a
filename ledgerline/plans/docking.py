"""Docking-result analytics.

Poses are `lineitem`: ligand = order, mode = line, affinity = -4 - 80 * discount, rmsd = 50 * tax, target = supplier mod 5.
Ligand features are those of the line's part; interaction types are line number mod 8, distance 2 + quantity / 20 and
angle 100 + quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.descriptors import clamp
from ledgerline.plans.evidence import numbered
from ledgerline.plans.structures import _LIG, ligand, structures
from ledgerline.registry import query
from ledgerline.sources.tables import read

#: Interaction types in order, the longest distance of a contact and the weight in the relevance.
INTERACTIONS = (("hydrogen_bond", 4.1, 0.25), ("hydrophobic", 4.0, 0.08), ("pi_stacking", 5.5, 0.35), ("pi_cation", 6.0, 0.2), ("salt_bridge", 5.5, 0.0), ("water_bridge", 4.5, 0.0), ("halogen_bond", 4.0, 0.0), ("metal_complex", 3.0, 0.0))
#: Of each type the shortest distance, and the range of angles in which it holds (two for stacking: parallel or T-shaped).
SHAPES = {
    "hydrogen_bond": (2.0, ((100, 180),)),
    "hydrophobic": (2.0, ((0, 180),)),
    "pi_stacking": (3.0, ((0, 30), (60, 180))),
    "pi_cation": (3.0, ((0, 45),)),
    "salt_bridge": (2.0, ((0, 180),)),
    "water_bridge": (0.0, ((0, 180),)),
    "halogen_bond": (2.5, ((120, 180),)),
    "metal_complex": (1.5, ((0, 180),)),
}
#: Targets in order (target number 0..4) and residues of their binding sites.
TARGETS = (
    ("GABRA1", ("TYR58:A", "PHE77:A", "TYR157:A", "HIS102:A", "TYR205:A", "SER205:A", "PHE200:B")),
    ("GRIN2B", ("TYR109:A", "ARG115:A", "SER132:A", "ASP136:A", "PHE114:A", "LYS131:A")),
    ("SCN1A", ("PHE387:A", "TYR1755:A", "PHE1764:A", "LEU1465:A", "VAL1466:A", "LEU1462:A")),
    ("GABRA2", ("TYR58:A", "TYR160:A", "SER204:A", "TYR210:A", "PHE77:A")),
    ("CACNA1H", ("PHE1503:A", "LEU1502:A", "ASN1499:A", "VAL1496:A")),
)

_POSES = "poses AS (SELECT l_orderkey AS ligand, l_linenumber AS mode, l_partkey, l_suppkey, -4 - 80 * l_discount AS affinity, 50 * l_tax AS rmsd, l_suppkey % 5 AS target, l_quantity FROM lineitem)"
_T = "targets AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}', {list(r)})" for i, (n, r) in enumerate(TARGETS)) + ") AS t(target, gene, residues))"


def poses(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ligand"), F.col("l_linenumber").alias("mode"), "l_partkey", "l_suppkey", (-4 - 80 * F.col("l_discount")).alias("affinity"), (50 * F.col("l_tax")).alias("rmsd"), (F.col("l_suppkey") % 5).alias("target"), "l_quantity")


def targets(spark) -> DataFrame:
    """The five targets, five rows."""
    rows = [F.struct(F.lit(i).cast("long").alias("target"), F.lit(n).alias("gene"), F.array(*(F.lit(x) for x in r)).alias("residues")) for i, (n, r) in enumerate(TARGETS)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


@query("d1_search_boxes", """WITH a AS (SELECT label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings WHERE label <> 3), l AS (SELECT DISTINCT label FROM embeddings)
    SELECT l.label, round(coalesce(avg(x), 0), 4) AS cx, round(coalesce(avg(y), 0), 4) AS cy, round(coalesce(avg(z), 0), 4) AS cz, round(CASE WHEN count(x) = 0 THEN 25 ELSE least(30, greatest(20, max(x) - min(x) + 6)) END, 4) AS size FROM l LEFT JOIN a ON l.label = a.label GROUP BY 1""")
def search_boxes(spark, d):
    """Centre and padded spread per structure; a structure without atoms (here label 3) gets the default box."""
    at = lambda i: F.element_at("embedding", i).cast("double") * 100
    e = read(spark, d, "embeddings")
    size = F.least(F.lit(30.0), F.greatest(F.lit(20.0), F.max("x") - F.min("x") + 6))
    boxes = e.where("label <> 3").select("label", at(1).alias("x"), at(2).alias("y"), at(3).alias("z")).groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), size.alias("size"))
    filled = lambda c, v: F.round(F.coalesce(c, F.lit(v)), 4).alias(c)
    return e.select("label").distinct().join(boxes, "label", "left").select("label", filled("cx", 0.0), filled("cy", 0.0), filled("cz", 0.0), filled("size", 25.0))


@query("d2_pose_confidence", f"WITH {_POSES} SELECT ligand, mode, l_partkey, l_suppkey, round(least(0.99, greatest(0.05, least(0.98, greatest(0.1, (-affinity - 2) / 12)) - (rmsd + 1.5 * rmsd) / 20)), 6) AS confidence FROM poses")
def pose_confidence(spark, d):
    """Bounds of the rmsd are rmsd and 1.5 * rmsd."""
    c = clamp(clamp((-F.col("affinity") - 2) / 12, 0.1, 0.98) - (F.col("rmsd") + 1.5 * F.col("rmsd")) / 20, 0.05, 0.99)
    return poses(spark, d).select("ligand", "mode", "l_partkey", "l_suppkey", F.round(c, 6).alias("confidence"))


@query("d3_best_pose", f"WITH {_POSES} SELECT ligand, target, round(min(affinity), 4) AS affinity, min_by(mode, row(affinity, mode, l_partkey, l_suppkey)) AS mode FROM poses GROUP BY 1, 2")
def best_pose(spark, d):
    order = F.struct("affinity", "mode", "l_partkey", "l_suppkey")
    return poses(spark, d).groupBy("ligand", "target").agg(F.round(F.min("affinity"), 4).alias("affinity"), F.min_by("mode", order).alias("mode"))


def consensus(a: Column, b: Column, alpha: float = 0.6, beta: float = 0.4, bias: float = 0.0) -> Column:
    """Weighted consensus of two scores; weights are scaled to a sum of one; clamped."""
    total = alpha + beta
    return clamp(alpha / total * a + beta / total * b + bias, -12, -4)


@query("d4_consensus", f"WITH {_POSES} SELECT ligand, mode, l_partkey, l_suppkey, round(least(-4, greatest(-12, 0.75 * affinity + 0.25 * (-5 - rmsd))), 6) AS score FROM poses")
def consensus_scores(spark, d):
    score = consensus(F.col("affinity"), -5 - F.col("rmsd"), 1.5, 0.5)
    return poses(spark, d).select("ligand", "mode", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


#: Weights of the terms of the first score.
TERMS = {"gauss1": -0.035579, "gauss2": -0.005156, "repulsion": 0.840245, "hydrophobic": -0.035069, "hbond": -0.587439, "rotor": 0.05846}


def term_scores(t: DataFrame, contacts: int = 5, bonds: int = 2) -> DataFrame:
    """Two closed-form scores of ligand features: v from contacts and bonds, a from energies."""
    c, w = F.col, TERMS
    raw = (
        w["gauss1"] * -(0.12 * c("heavy") + 0.4 * contacts) * 20
        + w["gauss2"] * -(0.05 * c("heavy") + 0.2 * contacts) * 20
        + w["repulsion"] * F.greatest(F.lit(0.0), (c("mw") - 500) * 0.001) * 2
        + w["hydrophobic"] * -(0.3 * contacts + 0.2 * F.greatest(F.lit(0.0), "logp")) * 10
        + w["hbond"] * -(0.6 * bonds + 0.05 * c("hbd") + 0.03 * c("hba")) * 3
        + w["rotor"] * c("rot")
    )
    a = -(0.08 * c("heavy") + c("mw") / 600) - (0.25 * c("hbd") + 0.15 * c("hba")) - 0.5 + 0.3 * (0.1 * c("logp") + c("tpsa") / 200) + 0.3 * c("rot") - 5
    return t.withColumns({"v": clamp(raw - c("mw") / 400 - 0.15 * c("logp") - 4.5, -12, -4), "a": clamp(a, -12, -4)})


_TERMS = f"""{_LIG}, sc AS (SELECT *, least(-4, greatest(-12, {TERMS['gauss1']} * -(0.12 * heavy + 2) * 20 + {TERMS['gauss2']} * -(0.05 * heavy + 1) * 20 + {TERMS['repulsion']} * greatest(0, (mw - 500) * 0.001) * 2
    + {TERMS['hydrophobic']} * -(1.5 + 0.2 * greatest(0, logp)) * 10 + {TERMS['hbond']} * -(1.2 + 0.05 * hbd + 0.03 * hba) * 3 + {TERMS['rotor']} * rot - mw / 400 - 0.15 * logp - 4.5))::DOUBLE AS v,
    least(-4, greatest(-12, -(0.08 * heavy + mw / 600) - (0.25 * hbd + 0.15 * hba) - 0.5 + 0.3 * (0.1 * logp + tpsa / 200) + 0.3 * rot - 5))::DOUBLE AS a FROM lig), hy AS (SELECT *, least(-4, greatest(-12, 0.6 * v + 0.4 * a))::DOUBLE AS hybrid FROM sc)"""


def scored_ligands(spark, d) -> DataFrame:
    t = term_scores(ligand(structures(spark, d).select("p_partkey", "s")))
    return t.withColumn("hybrid", consensus(F.col("v"), F.col("a")))


@query("d5_term_scores", f"WITH {_TERMS} SELECT p_partkey, round(v, 6) AS v, round(a, 6) AS a, round(hybrid, 6) AS hybrid FROM hy")
def ligand_scores(spark, d):
    return scored_ligands(spark, d).select("p_partkey", *(F.round(c, 6).alias(c) for c in ("v", "a", "hybrid")))


@query("d6_target_adjustment", f"WITH {_TERMS}, {_T} SELECT p_partkey, gene, round(hybrid + CASE gene WHEN 'GABRA1' THEN CASE WHEN arom >= 1 THEN -0.4 ELSE 0.2 END WHEN 'SCN1A' THEN CASE WHEN logp > 3 THEN -0.5 ELSE 0.3 END WHEN 'GRIN2B' THEN CASE WHEN mw > 400 THEN -0.3 ELSE 0.1 END WHEN 'GABRA2' THEN -0.35 ELSE CASE WHEN tpsa > 60 THEN -0.25 ELSE 0.1 END END, 6) AS affinity FROM hy, targets")
def target_adjustment(spark, d):
    """Every ligand against the five targets."""
    c = F.col
    shift = (
        F.when(c("gene") == "GABRA1", F.when(c("arom") >= 1, -0.4).otherwise(0.2))
        .when(c("gene") == "SCN1A", F.when(c("logp") > 3, -0.5).otherwise(0.3))
        .when(c("gene") == "GRIN2B", F.when(c("mw") > 400, -0.3).otherwise(0.1))
        .when(c("gene") == "GABRA2", -0.35)
        .otherwise(F.when(c("tpsa") > 60, -0.25).otherwise(0.1))
    )
    genes = F.explode(F.array(*(F.lit(n) for n, _ in TARGETS)))
    return scored_ligands(spark, d).withColumn("gene", genes).select("p_partkey", "gene", F.round(c("hybrid") + shift, 6).alias("affinity"))


@query("d7_rescoring", f"WITH {_TERMS}, r AS (SELECT *, least(-4, greatest(-12, hybrid - 0.05 * mw / 500 + 0.03 * logp - 0.02 * rot + 0.2)) AS re FROM hy) SELECT p_partkey, round(re, 6) AS rescored, round(re - v, 6) AS delta FROM r")
def rescoring(spark, d):
    c = F.col
    new = clamp(c("hybrid") - 0.05 * c("mw") / 500 + 0.03 * c("logp") - 0.02 * c("rot") + 0.04 * 5, -12, -4)
    return scored_ligands(spark, d).select("p_partkey", F.round(new, 6).alias("rescored"), F.round(new - c("v"), 6).alias("delta"))


@query("d8_library_ranking", f"WITH {_POSES}, b AS (SELECT ligand, min(affinity) AS a FROM poses WHERE rmsd <= 3.9 GROUP BY 1) SELECT ligand, round(a, 4) AS affinity, row_number() OVER (ORDER BY a, ligand)::BIGINT AS rank FROM b ORDER BY a, ligand LIMIT 100")
def library_ranking(spark, d):
    """The hundred best of the rows that did not fail (rmsd at most 3.9)."""
    top = poses(spark, d).where("rmsd <= 3.9").groupBy("ligand").agg(F.min("affinity").alias("a")).orderBy("a", "ligand").limit(100)
    return numbered(top, F.col("a").alias("x"), F.col("ligand").alias("y")).select("ligand", F.round("a", 4).alias("affinity"), "rank")


@query("d8_library_counts", f"WITH {_POSES} SELECT count(*) FILTER (rmsd <= 3.9)::BIGINT AS succeeded, count(*) FILTER (rmsd > 3.9)::BIGINT AS failed FROM poses")
def library_counts(spark, d):
    return poses(spark, d).agg(F.count_if(F.col("rmsd") <= 3.9).alias("succeeded"), F.count_if(F.col("rmsd") > 3.9).alias("failed"))


@query("d9_candidate_view", f"WITH {_POSES}, b AS (SELECT l_partkey, min(affinity) AS a FROM poses GROUP BY 1) SELECT coalesce(p_name, 'part ' || l_partkey) AS name, l_partkey, round(a, 4) AS affinity FROM b LEFT JOIN part ON p_partkey = l_partkey ORDER BY a, l_partkey LIMIT 25")
def candidate_view(spark, d):
    best = poses(spark, d).groupBy("l_partkey").agg(F.min("affinity").alias("a")).orderBy("a", "l_partkey").limit(25)
    name = F.coalesce("p_name", F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    return read(spark, d, "part").join(F.broadcast(best), F.col("p_partkey") == F.col("l_partkey"), "right").select(name.alias("name"), "l_partkey", F.round("a", 4).alias("affinity"))


CELL = max(m for _, m, _ in INTERACTIONS)
ATOMS = 20_000  # receptor atoms of one cell that share a join key; a parameter
WATER = "water_bridge"
_REACH = {n: m for n, m, _ in INTERACTIONS}
_LIKELY = "CASE kind " + " ".join(f"WHEN '{n}' THEN dist BETWEEN {SHAPES[n][0]} AND {m} AND (" + " OR ".join(f"angle BETWEEN {a} AND {b}" for a, b in SHAPES[n][1]) + ")" for n, m, _ in INTERACTIONS if n != WATER) + " END"


def near_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs of rows of two tables with columns x, y, z, at most `reach` apart: structs l and r, and dist.

    Distance join by grid: cells of the reach, the left side sent to its 27 neighbours, then the exact distance. A cell with more than ATOMS
    right rows is dealt over salts, to each of which its left rows go.
    """
    keys = ["c0", "c1", "c2"]
    cell = [F.floor(F.col(c) / reach) for c in "xyz"]
    near = F.expr("flatten(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> transform(sequence(-1, 1), k -> struct(i, j, k))))))")
    dealt = right.select(F.struct("*").alias("r"), *(c.alias(k) for c, k in zip(cell, keys, strict=True)))
    full = dealt.groupBy(*keys).agg(F.ceil(F.count("*") / ATOMS).alias("salts"))
    dealt = dealt.join(full, keys).withColumn("salt", F.pmod(F.xxhash64("r"), F.col("salts"))).drop("salts")
    sent = left.select(F.struct("*").alias("l"), F.explode(near).alias("o"), *(c.alias(f"own{i}") for i, c in enumerate(cell)))
    sent = sent.select("l", *((F.col(f"own{i}") + F.col(f"o.{o}")).alias(k) for i, (o, k) in enumerate(zip("ijk", keys, strict=True))))
    sent = sent.join(full, keys).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    apart = [F.pow(F.col(f"l.{c}") - F.col(f"r.{c}"), 2) for c in "xyz"]
    met = sent.join(dealt, [*keys, "salt"]).select("l", "r", F.sqrt(sum(apart[1:], apart[0])).alias("dist"))
    return met.where(F.col("dist") <= reach)


@query("d10_contacts", f"""WITH a AS (SELECT vec_id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v, embedding[6]::DOUBLE AS w FROM embeddings),
    re AS (SELECT *, {[n for n, _, _ in INTERACTIONS]}[1 + (label // 2 + vec_id) % 8] AS kind FROM a WHERE label % 2 = 1 AND label <> 9),
    p AS (SELECT l.vec_id AS ligand, r.kind, sqrt((l.x - r.x) ^ 2 + (l.y - r.y) ^ 2 + (l.z - r.z) ^ 2) AS dist, degrees(acos(greatest(-1, least(1, (l.u * r.u + l.v * r.v + l.w * r.w) / sqrt((l.u ^ 2 + l.v ^ 2 + l.w ^ 2) * (r.u ^ 2 + r.v ^ 2 + r.w ^ 2)))))) AS angle FROM a l JOIN re r ON l.label % 2 = 0),
    b AS (SELECT DISTINCT l.vec_id AS ligand, r.vec_id AS receptor FROM a w JOIN a l ON w.label = 9 AND l.label % 2 = 0 AND sqrt((l.x - w.x) ^ 2 + (l.y - w.y) ^ 2 + (l.z - w.z) ^ 2) <= {_REACH[WATER]} JOIN re r ON r.kind = '{WATER}' AND sqrt((w.x - r.x) ^ 2 + (w.y - r.y) ^ 2 + (w.z - r.z) ^ 2) <= {_REACH[WATER]})
    SELECT ligand, kind, count(*)::BIGINT AS contacts FROM (SELECT ligand, kind FROM p WHERE {_LIKELY} UNION ALL SELECT ligand, '{WATER}' FROM b) GROUP BY 1, 2""")
def contacts(spark, d):
    """Contacts of ligand atoms (even labels) by the type of the receptor atom (odd labels but 9), each type with its own distances and angles.

    A water bridge needs a water (label 9) within its distance of both: ligands and waters, waters and receptors meet by grid, and a
    ligand's receptors over any water count once.
    """
    at = lambda i: F.element_at("embedding", i).cast("double")
    names = F.array(*(F.lit(n) for n, _, _ in INTERACTIONS))
    atoms = read(spark, d, "embeddings").select("vec_id", "label", *((at(i) * 100).alias(c) for i, c in enumerate("xyz", 1)), *(at(i).alias(c) for i, c in enumerate("uvw", 4)))
    kind = names[((F.floor(F.col("label") / 2) + F.col("vec_id")) % len(INTERACTIONS)).cast("int")]
    ligands, receptors, waters = atoms.where("label % 2 = 0"), atoms.where("label % 2 = 1 AND label <> 9").withColumn("kind", kind), atoms.where("label = 9").select("vec_id", *"xyz")
    total = lambda terms: sum(terms[1:], terms[0])
    size = lambda p: total([F.pow(F.col(f"{p}.{c}"), 2) for c in "uvw"])
    angle = F.degrees(F.acos(clamp(total([F.col(f"l.{c}") * F.col(f"r.{c}") for c in "uvw"]) / F.sqrt(size("l") * size("r")), -1, 1)))
    direct = near_pairs(ligands, receptors.where(F.col("kind") != WATER), CELL).select(F.col("l.vec_id").alias("ligand"), F.col("r.kind").alias("kind"), "dist", angle.alias("angle")).where(F.expr(_LIKELY))
    return direct.select("ligand", "kind").unionByName(water_bridges(ligands, waters, receptors.where(F.col("kind") == WATER)).select("ligand", F.lit(WATER).alias("kind"))).groupBy("ligand", "kind").agg(F.count("*").alias("contacts"))


def water_bridges(ligands: DataFrame, waters: DataFrame, receptors: DataFrame, reach: float = _REACH[WATER]) -> DataFrame:
    """(ligand, receptor) with a water within reach of both; all tables have vec_id, x, y, z."""
    place = ["vec_id", "x", "y", "z"]
    wet = near_pairs(ligands.select(*place), waters.select(*place), reach).select(F.col("l.vec_id").alias("ligand"), F.col("r.vec_id").alias("water"))
    held = near_pairs(receptors.select(*place), waters.select(*place), reach).select(F.col("l.vec_id").alias("receptor"), F.col("r.vec_id").alias("water"))
    return wet.join(held, "water").select("ligand", "receptor").distinct()


_KIND = "CASE l_linenumber % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _, _) in enumerate(INTERACTIONS)) + " END"
_INTER = f"inter AS (SELECT l_orderkey AS ligand, l_linenumber, l_partkey, l_suppkey, {_KIND} AS kind, 2 + l_quantity / 20 AS dist, 100 + l_quantity AS angle FROM lineitem)"


def interactions(spark, d) -> DataFrame:
    names = F.array(*(F.lit(n) for n, _, _ in INTERACTIONS))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ligand"), "l_linenumber", "l_partkey", "l_suppkey", names[F.col("l_linenumber") % 8].alias("kind"), (2 + F.col("l_quantity") / 20).alias("dist"), (100 + F.col("l_quantity")).alias("angle"))


@query("d11_interaction_strength", f"""WITH {_INTER} SELECT ligand, l_linenumber, l_partkey, l_suppkey, kind, round(CASE kind WHEN 'hydrophobic' THEN greatest(0.1, 1 - (dist - 2) / 2.5) WHEN 'hydrogen_bond' THEN greatest(0.1, (1 - abs(dist - 2.9) / 1.5) * angle / 180)
    WHEN 'pi_stacking' THEN greatest(0.2, 1 - (dist - 3.5) / 2.5) WHEN 'salt_bridge' THEN greatest(0.3, 1.2 - dist / 5) WHEN 'pi_cation' THEN 0.6 WHEN 'halogen_bond' THEN 0.5 ELSE 0.45 END, 6) AS strength FROM inter""")
def interaction_strength(spark, d):
    dist, kind = F.col("dist"), F.col("kind")
    strength = (
        F.when(kind == "hydrophobic", F.greatest(F.lit(0.1), 1 - (dist - 2) / 2.5))
        .when(kind == "hydrogen_bond", F.greatest(F.lit(0.1), (1 - F.abs(dist - 2.9) / 1.5) * F.col("angle") / 180))
        .when(kind == "pi_stacking", F.greatest(F.lit(0.2), 1 - (dist - 3.5) / 2.5))
        .when(kind == "salt_bridge", F.greatest(F.lit(0.3), 1.2 - dist / 5))
        .when(kind == "pi_cation", 0.6)
        .when(kind == "halogen_bond", 0.5)
        .otherwise(0.45)
    )
    return interactions(spark, d).select("ligand", "l_linenumber", "l_partkey", "l_suppkey", "kind", F.round(strength, 6).alias("strength"))


_NEAR = "CASE kind " + " ".join(f"WHEN '{n}' THEN {m}" for n, m, _ in INTERACTIONS) + " END"
_PROFILE = f"""{_INTER}, near AS (SELECT * FROM inter WHERE dist <= {_NEAR}), prof AS (SELECT ligand, count(*)::BIGINT AS total, count(*) FILTER (kind = 'hydrogen_bond')::BIGINT AS hb, count(*) FILTER (kind = 'pi_stacking')::BIGINT AS pi,
    count(*) FILTER (kind = 'hydrophobic')::BIGINT AS hyd, round(least(1, sum(CASE kind WHEN 'hydrogen_bond' THEN 0.25::DOUBLE WHEN 'pi_stacking' THEN 0.35 WHEN 'hydrophobic' THEN 0.08 WHEN 'pi_cation' THEN 0.2 ELSE 0 END)), 3) AS relevance,
    list('P' || l_partkey ORDER BY l_linenumber, l_partkey) FILTER (kind = 'hydrogen_bond') AS bonds, list('P' || l_partkey ORDER BY l_linenumber, l_partkey) FILTER (kind = 'pi_stacking') AS stackings FROM near GROUP BY 1)"""


def lookup(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def profiles(spark, d) -> DataFrame:
    """Contacts within their type's distance, summed per ligand, with the capped relevance."""
    kind = F.col("kind")
    near = interactions(spark, d).where(F.col("dist") <= lookup(kind, {n: m for n, m, _ in INTERACTIONS}))
    weight = lookup(kind, {n: w for n, _, w in INTERACTIONS})
    of = lambda n: F.count_if(kind == n)
    return near.groupBy("ligand").agg(F.count("*").alias("total"), of("hydrogen_bond").alias("hb"), of("pi_stacking").alias("pi"), of("hydrophobic").alias("hyd"), F.round(F.least(F.lit(1.0), F.sum(weight)), 3).alias("relevance"))


_MAP = "SELECT ligand, string_agg(kind || '=' || n, ';' ORDER BY kind) AS by_type FROM (SELECT ligand, kind, count(*) AS n FROM near GROUP BY 1, 2) GROUP BY 1"


@query("d12_profile_summary", f"WITH {_PROFILE} SELECT ligand, total, by_type, relevance FROM prof JOIN ({_MAP}) USING (ligand)")
def profile_summary(spark, d):
    """Contacts of each ligand: their number, a map of numbers by type (shown in order), and the relevance."""
    near = interactions(spark, d).where(F.col("dist") <= lookup(F.col("kind"), {n: m for n, m, _ in INTERACTIONS}))
    counts = near.groupBy("ligand", "kind").agg(F.count("*").alias("n"))  # eight types at most
    weight = lookup(F.col("kind"), {n: w for n, _, w in INTERACTIONS})
    t = counts.groupBy("ligand").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("types"), F.round(F.least(F.lit(1.0), F.sum(F.col("n") * weight)), 3).alias("relevance"))
    return t.select("ligand", "total", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("by_type"), "relevance")


@query("d13_profile_ranking", f"WITH {_PROFILE} SELECT ligand, relevance, total, row_number() OVER (ORDER BY relevance DESC, total DESC, ligand)::BIGINT AS rank FROM prof ORDER BY rank LIMIT 5")
def profile_ranking(spark, d):
    top = profiles(spark, d).select("ligand", "relevance", "total").orderBy(F.desc("relevance"), F.desc("total"), "ligand").limit(5)
    return numbered(top, (-F.col("relevance")).alias("a"), (-F.col("total")).alias("b"), F.col("ligand").alias("c"))


@query("d14_insight_text", f"WITH {_PROFILE} SELECT ligand, concat_ws('; ', CASE WHEN hb > 0 THEN 'hydrogen bonds with ' || array_to_string(bonds[1:2], ', ') END, CASE WHEN pi > 0 THEN 'stacking with ' || array_to_string(stackings[1:2], ', ') END, CASE WHEN hyd >= 5 THEN 'hydrophobic pocket' END, CASE WHEN relevance > 0.6 THEN 'modulator hypothesis' ELSE 'weak hypothesis' END) AS insight FROM prof")
def insight_text(spark, d):
    """The first two bonds and stackings of each ligand, the pocket rule, and a hypothesis by relevance."""
    near = interactions(spark, d).where(F.col("dist") <= lookup(F.col("kind"), {n: m for n, m, _ in INTERACTIONS})).where(F.col("kind").isin("hydrogen_bond", "pi_stacking"))
    first = F.row_number().over(Window.partitionBy("ligand", "kind").orderBy("l_linenumber", "l_partkey"))
    two = near.withColumn("nth", first).where("nth <= 2").groupBy("ligand")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("nth", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name")))))["name"]
    names = two.agg(F.array_join(of("hydrogen_bond"), ", ").alias("bonds"), F.array_join(of("pi_stacking"), ", ").alias("stackings"))
    shown = lambda c, what: F.when(F.col(c) != "", F.concat(F.lit(what), F.col(c)))
    parts = [shown("bonds", "hydrogen bonds with "), shown("stackings", "stacking with "), F.when(F.col("hyd") >= 5, "hydrophobic pocket"), F.when(F.col("relevance") > 0.6, "modulator hypothesis").otherwise("weak hypothesis")]
    return profiles(spark, d).join(names, "ligand", "left").select("ligand", F.concat_ws("; ", *parts).alias("insight"))


@query("d15_residue_classes", f"WITH {_POSES}, {_T}, r AS (SELECT target, unnest(residues) AS r FROM targets), n AS (SELECT target, count(*)::BIGINT AS poses FROM poses GROUP BY 1) SELECT target, poses, count(*) FILTER (regexp_matches(r, '^(PHE|TYR|TRP|HIS)'))::BIGINT AS aromatic, count(*) FILTER (regexp_matches(r, '^(SER|THR|ASN|GLN|TYR|HIS)'))::BIGINT AS polar, count(*) FILTER (regexp_matches(r, '^(ARG|LYS|ASP|GLU)'))::BIGINT AS charged FROM r JOIN n USING (target) GROUP BY 1, 2")
def residue_classes(spark, d):
    r = targets(spark).select("target", F.explode("residues").alias("r"))
    of = lambda p: F.count_if(F.col("r").rlike(f"^({p})"))
    classes = r.groupBy("target").agg(of("PHE|TYR|TRP|HIS").alias("aromatic"), of("SER|THR|ASN|GLN|TYR|HIS").alias("polar"), of("ARG|LYS|ASP|GLU").alias("charged"))
    return poses(spark, d).groupBy("target").agg(F.count("*").alias("poses")).join(F.broadcast(classes), "target")


@query("d16_fit_meter", f"WITH {_POSES} SELECT ligand, mode, l_partkey, l_suppkey, round((abs(least(-3.5, greatest(-9.5, affinity + 0.013))) - 3.5) / 6 * 100)::BIGINT AS meter, CASE WHEN affinity <= -8 THEN 'strong' WHEN affinity <= -7 THEN 'good' WHEN affinity <= -6 THEN 'fair' ELSE 'weak' END AS verdict FROM poses")
def fit_meter(spark, d):
    a = F.col("affinity")
    meter = F.round((F.abs(clamp(a + 0.013, -9.5, -3.5)) - 3.5) / 6 * 100).cast("long")
    return poses(spark, d).select("ligand", "mode", "l_partkey", "l_suppkey", meter.alias("meter"), F.when(a <= -8, "strong").when(a <= -7, "good").when(a <= -6, "fair").otherwise("weak").alias("verdict"))


@query("d17_target_resolution", "SELECT s_suppkey, coalesce(n_name, r.r_name, 'default') AS target, coalesce(n_nationkey, 100 + r.r_regionkey, 25)::BIGINT AS box FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 3 = 0 LEFT JOIN region r ON r.r_regionkey = s_nationkey % 7")
def target_resolution(spark, d):
    """By the first key, else by the second, else a default; each field on its own."""
    by_gene = read(spark, d, "nation").where("n_nationkey % 3 = 0")
    by_id = read(spark, d, "region")
    t = read(spark, d, "supplier").join(by_gene, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(by_id, F.col("r_regionkey") == F.col("s_nationkey") % 7, "left")
    return t.select("s_suppkey", F.coalesce("n_name", "r_name", F.lit("default")).alias("target"), F.coalesce("n_nationkey", 100 + F.col("r_regionkey"), F.lit(25)).cast("long").alias("box"))


#: Of each docking column the keys that may hold it, in order, and its default; in terms of the affinity where that is named.
DEFAULTS = {
    "affinity": (("affinity", "binding_affinity"), "-7.0"),
    "efficiency": (("ligand_efficiency",), "affinity / 20.0"),
    "intermolecular": (("intermolecular_energy",), "affinity * 0.85"),
    "torsional": (("torsional_energy",), "0.5"),
    "desolvation": (("desolvation_energy",), "0.0"),
    "hbonds": (("num_hbonds", "hbond_count"), "2.0"),
    "hydrophobic": (("num_hydrophobic_contacts",), "5.0"),
    "vdw": (("num_vdw_contacts",), "10.0"),
    "electrostatic": (("electrostatic_score",), "0.0"),
    "occupancy": (("pocket_occupancy",), "0.6"),
}
#: The tables' payloads hold a number k alone: it makes payloads of five kinds, of which one is null.
_PAYLOAD = """SELECT event_id, CASE k % 5 WHEN 0 THEN '{"affinity": -' || k || '.5, "num_hbonds": ' || k || '}' WHEN 1 THEN '{"binding_affinity": -' || k || ', "hbond_count": 3, "ligand_efficiency": 0.25}' WHEN 2 THEN '{"num_hydrophobic_contacts": ' || k || ', "num_vdw_contacts": 7, "pocket_occupancy": 0.9}'
    WHEN 3 THEN '{"affinity": -6, "intermolecular_energy": -9.25, "torsional_energy": 1.5, "desolvation_energy": 0.125, "electrostatic_score": -2}' END AS payload FROM (SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events)"""
_FIELD = "(payload::JSON ->> '$.{}')::DOUBLE".format
_DEFAULTED = ", ".join(f"round(coalesce({', '.join(map(_FIELD, keys))}, {default}), 6)::DOUBLE AS {c}" for c, (keys, default) in DEFAULTS.items() if c != "affinity")


@query("d18_feature_defaults", f"WITH j AS ({_PAYLOAD}), a AS (SELECT *, coalesce({', '.join(map(_FIELD, DEFAULTS['affinity'][0]))}, -7.0)::DOUBLE AS affinity FROM j) SELECT event_id, affinity, {_DEFAULTED} FROM a")
def feature_defaults(spark, d):
    """The ten docking columns of each payload, by any of their keys, or their defaults; a payload that is null has all defaults."""
    k = F.get_json_object("props", "$.k")
    put = lambda *parts: F.concat(*(k if p is None else F.lit(p) for p in parts))
    kind = k.cast("long") % 5
    payload = (
        F.when(kind == 0, put('{"affinity": -', None, '.5, "num_hbonds": ', None, "}"))
        .when(kind == 1, put('{"binding_affinity": -', None, ', "hbond_count": 3, "ligand_efficiency": 0.25}'))
        .when(kind == 2, put('{"num_hydrophobic_contacts": ', None, ', "num_vdw_contacts": 7, "pocket_occupancy": 0.9}'))
        .when(kind == 3, put('{"affinity": -6, "intermolecular_energy": -9.25, "torsional_energy": 1.5, "desolvation_energy": 0.125, "electrostatic_score": -2}'))
    )
    t = with_defaults(read(spark, d, "events").select("event_id", payload.alias("payload")), "payload")
    return t.select("event_id", *(F.round(c, 6).alias(c) for c in DEFAULTS))


def with_defaults(t: DataFrame, payload: str) -> DataFrame:
    """Adds the docking columns of a JSON payload; values that do not parse count as missing."""
    at = lambda p: F.get_json_object(payload, f"$.{p}").try_cast("double")
    column = lambda keys, default: F.coalesce(*map(at, keys), F.expr(default).cast("double"))
    t = t.withColumn("affinity", column(*DEFAULTS["affinity"]))
    return t.withColumns({c: column(*v) for c, v in DEFAULTS.items() if c != "affinity"})
