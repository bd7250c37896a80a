"""An inverted index with score bounds, and top-k searches that stop by them.

Postings are stored once, clustered by term: (term, block, most, entries), `most` the greatest weight in a block of about BLOCK documents. A
second table has each document's own vector. A search of many questions at once goes in three steps:

1. The terms of a question that can add most, as far as about START postings, give partial scores; the kth is a threshold.
2. Terms that together cannot reach the threshold are left out. A document that has only such terms is no hit, so
   candidates come from the other terms' postings, without blocks that cannot reach it, and of the candidates those stay whose partial score and
   all of the left-out terms reach it.
3. What stays is scored whole, from the documents' own vectors. Common terms are only read there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.files import written

BLOCK, START = 512, 4096
#: Terms are left out up to this share of the threshold: a candidate must have the other part from the terms that are asked, or it is not scored whole.
LEFT_OUT = 0.4
#: Scores are rounded to six digits before they are ranked: a threshold is taken that much lower.
SLACK = 1.1e-6


class Postings:
    """terms: term, df, most; blocks: term, block, most, entries array<struct<doc_id, w>>; vectors: doc_id, entries array<struct<term, w>>."""

    def __init__(self, terms: DataFrame, blocks: DataFrame, vectors: DataFrame) -> None:
        self.terms, self.blocks, self.vectors = terms, blocks, vectors

    @classmethod
    def build(cls, weights: DataFrame) -> Postings:
        """From weights(doc_id, term, w), w over 0, one row for each pair."""
        weights = written(weights.select("doc_id", "term", "w"))
        terms = written(weights.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("most")))
        block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / BLOCK)).cast("int")
        cut = weights.join(terms.select("term", "df"), "term").withColumn("block", block)
        blocks = cut.groupBy("term", "block").agg(F.max("w").alias("most"), F.collect_list(F.struct("doc_id", "w")).alias("entries"))
        vectors = weights.groupBy("doc_id").agg(F.collect_list(F.struct("term", "w")).alias("entries"))
        return cls(terms, written(blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block")), written(vectors))

    def top(self, questions: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """questions(item_id, term, qw), qw over 0 → item_id, doc_id, score: the k documents of each with the greatest sums of qw * w, ties to the smaller doc_id."""
        q = written(questions.join(self.terms, "term").withColumn("ub", F.col("qw") * F.col("most")))
        best_first = Window.partitionBy("item_id").orderBy(F.desc(F.col("ub") / F.sqrt("df")), "term")
        before = F.sum("df").over(best_first.rowsBetween(Window.unboundedPreceding, -1))
        start = q.withColumn("read", F.coalesce(before, F.lit(0))).where(F.col("read") < START)
        kth = F.get(F.sort_array(F.collect_list("part"), False), k - 1)
        parts = _ranked(self._partial(start.select("item_id", "term", "qw")), k, "part")
        least = parts.groupBy("item_id").agg(F.coalesce(kth, F.lit(0.0)).alias("least"))
        worst_first = Window.partitionBy("item_id").orderBy("ub", "term")
        told = q.join(least, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
        told = told.withColumns({"below": F.sum("ub").over(worst_first), "all_": F.sum("ub").over(Window.partitionBy("item_id"))})
        told = written(told.withColumn("asked", F.col("below") >= LEFT_OUT * F.col("least")))
        # what the left-out terms may add
        rest = told.groupBy("item_id").agg(F.max("least").alias("least"), F.coalesce(F.sum(F.when(~F.col("asked"), F.col("ub"))), F.lit(0.0)).alias("rest"))
        found = written(self._partial(told.where("asked"), F.col("qw") * F.col("blocks.most") + F.col("all_") - F.col("ub") >= F.col("least")))
        # these scores lack the left-out terms only: their kth is a higher threshold
        again = _ranked(found, k, "part").groupBy("item_id").agg((kth - SLACK).alias("now"))
        bound = rest.join(again, "item_id", "left").select("item_id", "rest", F.greatest("least", F.coalesce("now", "least")).alias("least"))
        keep = found.join(bound, "item_id").where(F.col("part") + F.col("rest") >= F.col("least")).select("item_id", "doc_id")
        asked = q.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "qw"))).alias("asked"))  # a question's terms
        whole = keep.join(asked, "item_id").join(self.vectors, "doc_id")
        dot = F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["w"] * F.coalesce(F.col("asked")[e["term"]], F.lit(0.0)))
        return _ranked(whole.select("item_id", "doc_id", F.round(dot, digits).alias("score")).where("score > 0"), k, "score")

    def most_alike(self, questions: DataFrame, least: float) -> DataFrame:
        """questions(item_id, term), distinct, against an index of distinct terms → item_id, doc_id, i, a, b: shared terms and both sizes of
        all pairs that can be the most alike of their question by Jaccard similarity, or are alike by more than `least`.

        A similarity of s needs s * a shared terms, so all but the s * a commonest terms of a question are asked: a pair without one of
        them is below s. s comes from the documents that share most of the START rarest postings.
        """
        q = written(questions.join(self.terms.select("term", "df"), "term", "left").na.fill(0, ["df"]))
        asked = written(q.groupBy("item_id").agg(F.collect_list("term").alias("asked"), F.count("*").alias("a")))  # a question's terms
        rare_first, common_first = (Window.partitionBy("item_id").orderBy(o, "term") for o in (F.asc("df"), F.desc("df")))
        read = F.sum("df").over(rare_first) - F.col("df")
        start = q.withColumn("read", read).where(F.col("read") < START).select("item_id", "term", F.lit(1.0).alias("qw"))
        first = self._shared(_ranked(self._partial(start), 5, "part").select("item_id", "doc_id"), asked)
        s = first.groupBy("item_id").agg(F.max(F.col("i") / (F.col("a") + F.col("b") - F.col("i"))).alias("s"))
        bound = asked.join(s, "item_id", "left").select("item_id", "a", F.least(F.lit(least), F.coalesce("s", F.lit(0.0)) - 1e-9).alias("s"))
        bound = written(bound.withColumn("left_out", F.greatest(F.lit(0), F.ceil(F.col("s") * F.col("a")) - 1)))
        rest = q.withColumn("place", F.row_number().over(common_first)).join(bound, "item_id").where(F.col("place") > F.col("left_out"))
        found = self._partial(rest.select("item_id", "term", F.lit(1.0).alias("qw"))).join(bound, "item_id")
        sizes = self.vectors.select("doc_id", F.size("entries").alias("b"))
        enough = F.col("part") + F.col("left_out") >= F.col("s") * (F.col("a") + F.col("b")) / (1 + F.col("s")) - 1e-9
        return self._shared(found.join(sizes, "doc_id").where(enough).select("item_id", "doc_id"), asked)

    def _shared(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        whole = pairs.join(asked, "item_id").join(self.vectors, "doc_id")
        return whole.select("item_id", "doc_id", F.size(F.array_intersect("asked", "entries.term")).alias("i"), "a", F.size("entries").alias("b"))

    def _partial(self, asked: DataFrame, reaches: Column | None = None) -> DataFrame:
        met = asked.join(self.blocks.alias("blocks"), "term")
        met = met if reaches is None else met.where(reaches)
        e = met.select("item_id", "qw", F.explode("entries").alias("e"))
        return e.groupBy("item_id", F.col("e.doc_id").alias("doc_id")).agg(F.sum(F.col("qw") * F.col("e.w")).alias("part"))


def _ranked(t: DataFrame, k: int, by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(by), "doc_id")).cast("long")
    return t.withColumn("rank", rank).where(F.col("rank") <= k)
