"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Every document gets the key -ln(u) / w, with u a uniform number hashed from its id, seed and
text and w its quality weight; lower keys are taken first. A source whose target is e times its size
and a fraction more is taken whole e times (complete epochs), then its documents in key order
up to the rest of its token budget.

No source is sorted in one task: keys fall into ranges per source, the ranges' sizes are summed
before anything is sorted, and only the one range of each source in which the budget ends is
ordered (its prefix sums decide document by document). A source that holds a third of all rows
is spread over all ranges. Only the table of sources (one row each) is ever in one task.

Defined results: a null text has size 0 and is never taken in the fractional part; the null
source is a source of its own, the last one; texts of any length are counted whole; other columns, whatever their names, are
ignored; repeated rows are taken or left each by itself
(their order is fixed by id, size and text hash); an empty table gives an empty mix. Null,
non-positive or non-finite weights count as the smallest weight, 1e-6.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, pieces, stage


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_quality(text: Column) -> Column:
    """Quality weight of a text where no other is given: the squared share of its characters that are letters, blanks or plain punctuation."""
    plain = F.length(F.translate(F.coalesce(text, F.lit("")), "0123456789$%&*#@|<>{}[]\\^~=+_", ""))
    return F.pow(plain / F.greatest(F.length(text), F.lit(1)), 2)


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sources(source, source_size) with `target` words.

    Source i in code-point order (null last) weighs weights[i mod n]; share * all words are
    dealt by weight; a target stops at cap * its source's size and the excess goes to the
    others by weight. With the sources ordered by cap / weight, those up to some place are
    capped; the first place where the level of the rest no longer exceeds the next cap
    has the highest such level, since the level only falls after it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * float(cap)).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * float(share)
    t = t.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return t.withColumn("target", F.least(F.coalesce(level * F.col("w"), F.col("cap")), F.col("cap"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 17, quality: Column | None = None, range_rows: int = 20_000) -> DataFrame:
    """docs(doc_id, text, source, …) → doc_id, size, source, source_size, target, times, taken.

    times: how often the mix takes the document whole; taken = size * times. quality: a column of docs (or of labels
    joined to them) as quality weight, letter_quality of the text by default. range_rows: about
    how many documents of a source one key range holds (it sets the number of ranges).
    """
    key = F.struct("doc_id", "size", "text_hash")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) + 0.5) / float(1 << 53)
    weight = quality if quality is not None else letter_quality(F.col("text"))
    weight = F.when(weight.isNull() | F.isnan(weight) | (weight == float("inf")) | (weight < 1e-6), 1e-6).otherwise(weight)
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), weight.alias("weight"))
    slim = stage(slim.withColumn("key", -F.log(u) / F.col("weight")))

    # ranges of a mean of 1 - exp(-key / scale): keys of weight 1 spread evenly over most of them, keys of a
    # small weight (the scales reach 1e6) over one of the other parts
    ranges = pieces(slim.count(), range_rows, 64)
    spread = sum(((1 - F.exp(-F.col("key") / 10.0**i)) * 0.05 for i in range(1, 7)), (1 - F.exp(-F.col("key"))) * 0.7)
    slim = slim.withColumn("range", F.floor(spread * ranges))
    sums = slim.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("before", F.sum("range_size").over(running) - F.col("range_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # the range in which the budget ends, and what it still has at its start
    last = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).where("s.before <= t.budget")
    last = last.groupBy(F.col("t.source").alias("source")).agg(F.max("s.range").alias("last_range"), F.max("s.before").alias("last_before"))
    plan = targets.join(last, same(targets, last), "left").select(targets["source"].alias("plan_source"), "source_size", "target", "epochs", "budget", "last_range", "last_before")
    # rows meet their source's plan range by range, so a hot source is no hot key
    by_range = sums.select("source", "range").alias("s").join(plan, F.col("s.source").eqNullSafe(F.col("plan_source"))).select("plan_source", F.col("s.range").alias("plan_range"), *plan.columns[1:])
    t = slim.join(by_range, slim["source"].eqNullSafe(by_range["plan_source"]) & (slim["range"] == by_range["plan_range"])).drop("plan_source", "plan_range")
    whole = F.col("range") < F.col("last_range")
    edge = F.col("range") == F.col("last_range")
    # rows outside the edge range need no order: they are spread by hash, not gathered by source
    spot = F.when(edge, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "text_hash", "size"), F.lit(1 << 20)) + 1)
    t = t.withColumn("spot", spot)
    order = Window.partitionBy("source", "spot").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    edges = t.where("spot = 0").withColumn("seen", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("last_before"))
    chosen = edges.withColumn("extra", (F.col("budget") - F.col("seen") >= F.col("size") / 2) & (F.col("size") > 0)).drop("seen")
    rest = t.where("spot > 0 or spot is null").withColumn("extra", F.coalesce(whole, F.lit(False)) & (F.col("size") > 0))
    times = F.col("epochs") + F.col("extra").cast("long")
    out = chosen.unionByName(rest).withColumn("times", times)
    return out.select("doc_id", "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", "times", (F.col("size") * F.col("times")).alias("taken"), "text_hash")
