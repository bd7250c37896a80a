"""Descriptor columns of a structure string: counts of its characters and uniform numbers from its md5.

Nothing parses the structure; every column is a deterministic expression of the string, so that a descriptor pass is
one projection inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(s: Column, seed: int | str, low: float, high: float) -> Column:
    """A number in [low, high): the first 32 bits of md5(s_seed) mod 10^6, as a millionth."""
    bits = F.conv(F.substring(F.md5(F.concat(s, F.lit(f"_{seed}"))), 1, 8), 16, 10).cast("long")
    return F.lit(float(low)) + (bits % 1000000) / F.lit(1000000.0) * F.lit(float(high) - float(low))


def count_of(s: Column, pattern: str) -> Column:
    """How often a pattern matches, as a long."""
    return F.regexp_count(s, F.lit(pattern)).cast("long")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high).cast("double"), F.greatest(F.lit(low).cast("double"), c))


def heavy_atoms(s: Column) -> Column:
    """Tokens (bracket groups, two-letter halogens, element letters) that are not hydrogen; at least one."""
    tokens = F.regexp_extract_all(s, F.lit(r"\[.*?\]|Br|Cl|[A-Z][a-z]?|[a-z]"), 0)
    kept = F.filter(tokens, lambda t: F.regexp_replace(t, r"[\[\]]", "").isin("H", "h") == False)  # noqa: E712
    return F.greatest(F.lit(1), F.size(kept)).cast("long")


def with_descriptors(t: DataFrame, column: str = "s") -> DataFrame:
    """Adds the descriptor columns of a structure string."""
    s = F.trim(F.col(column))
    n = lambda p: count_of(s, p)
    t = t.withColumns({"c_": n("[Cc]"), "n_": n("[Nn]"), "o_": n("[Oo]"), "s_": n("[Ss]"), "hal_": n("F") + n("Cl") + n("Br") + n("I"), "heavy": heavy_atoms(s), "digits_": n("[0-9]")})
    # weighted counts are summed as whole tenths and thousandths: a sum of doubles may fall short of the number that floor sees
    c, u = F.col, lambda seed, low, high: uniform(s, seed, low, high)
    t = t.withColumns(
        {
            "mw": F.greatest(F.lit(60.0), (12011 * c("c_") + 14007 * c("n_") + 15999 * c("o_") + 32060 * c("s_") + 19000 * c("hal_")) / 1000 + u(1, -15, 15) + 1.5 * c("heavy")),
            "logp": clamp((3 * c("c_") - 10 * c("o_") - 8 * c("n_") - 2 * c("s_")) / 10 / 3 + u(2, -1.5, 1.5), -5, 10),
            "hbd": F.floor(4 * n("[ON]") / 10 + u(3, 0, 3)),
            "hba": F.floor(6 * (c("o_") + c("n_")) / 10 + u(4, 0, 4)),
            "tpsa": clamp(17 * c("o_") + 13 * c("n_") + 5 * c("s_") + u(5, 0, 20), 0, 300),
            "rot": clamp(n("-") + F.floor(c("c_") / 4) + u(6, 0, 4), 0, 20).cast("long"),
            "rings": F.least(F.lit(7), F.floor(c("digits_") / 2) + u(7, 0, 2).cast("long")).cast("long"),
            "csp3": clamp(n("C") / F.greatest(F.lit(1), c("c_")) + u(9, -0.1, 0.1), 0, 1),
            "balaban": 1 + u(11, 0, 3),
            "qed": u(13, 0.2, 0.9),
            "het": ((c("n_") + c("o_") + c("s_")) > 0).cast("long"),
            "amide": n(r"C\(=O\)N") + n(r"C\(=O\)NC"),
        }
    )
    aromatic = F.floor((n("c") + F.floor(n("n") / 2) + F.floor(n("o") / 4)) / 4) + u(8, 0, 2).cast("long")
    t = t.withColumns({"arom": F.least(c("rings"), aromatic).cast("long"), "bertz": 15 * c("heavy") + 25 * c("rings") + u(10, 0, 500), "mr": c("mw") / 4 + u(12, -5, 5)})
    return t.withColumn("aliphatic", c("rings") - c("arom")).drop("c_", "n_", "o_", "s_", "hal_", "digits_")


def byte_hashes(s: Column, n: int) -> Column:
    """Byte i of md5 as a share of 255; 0.5 beyond its sixteen bytes."""
    return F.array(*(F.conv(F.substring(F.md5(s), 2 * i + 1, 2), 16, 10).cast("double") / 255 if i < 16 else F.lit(0.5) for i in range(n)))
