"""Column builders used by several queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(s: Column, seed: str, low: float, high: float) -> Column:
    """A number in [low, high] from the first 32 bits of md5(s_seed)."""
    bits = F.conv(F.substring(F.md5(F.concat(s, F.lit("_" + seed))), 1, 8), 16, 10).cast("double")
    return F.lit(low) + bits / F.lit(float(0xFFFFFFFF)) * F.lit(high - low)


def contains_any(columns: list[Column], text: str) -> Column:
    """Any of the columns contains the text, in any case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return out


def significant_words(c: Column) -> Column:
    """Distinct lower-cased words of at least four letters."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z ]", ""), " +"), lambda w: F.length(w) >= 4))
