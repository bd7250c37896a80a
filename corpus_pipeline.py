"""A training corpus from `documents`: toxic texts go, one of each near-duplicate group stays, secrets are
redacted, sources are mixed to target weights, and the mix is packed into sequences.

Each stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read again as the next one's docs. All
but the last return the columns of docs. SQL cannot express the stages (a trained machine, hashed sampling, a
tokenizer); tests compare them with brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import fresh, stage
from ledgerline.llm.jaccard_join import jaccard_components
from ledgerline.llm.mixing import mix_sources
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.queries import TOKEN_RANKS, toxicity_model
from ledgerline.llm.secrets import EXAMPLE_OWNERS, redact, scan_secrets
from ledgerline.llm.toxicity import score_toxicity


NODE = 1 << 62  # ids from here on stand for rows whose doc_id is not theirs alone


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; the model knows the labels that are not held out.

    Null and empty texts have the curve's score for none and stay; repeated rows are judged alike; very long texts are
    read whole. Without labels of both classes, and from an empty table, all rows stay.
    """
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = fresh("toxicity", docs.columns)
    return score_toxicity(docs, model, out=out).where(F.col(out) < 0.7).drop(out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 on five-word shingles one row stays, the smallest id's.

    Rows that share an id but not the text are documents of their own (and come after the other ids of a group); equal rows
    of one id stay once, and equal texts of different ids are one group. Null and empty texts link with nothing and stay, as
    do rows with a null id; texts of any length are read whole; an empty table stays empty.
    """
    node, one, two = (fresh(c, docs.columns) for c in ("node", "one", "two"))
    hashed = docs.withColumns({one: F.xxhash64("text"), two: F.xxhash64(F.lit(8), "text")})
    shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    own = stage(hashed.select("doc_id", one, two).join(shared, "doc_id").distinct().withColumn(node, F.lit(NODE) + F.monotonically_increasing_id()))
    noded = hashed.join(own, ["doc_id", one, two], "left").withColumn(node, F.coalesce(node, F.col("doc_id").cast("long"))).select(*docs.columns, node)
    groups = jaccard_components(noded.select(F.col(node).alias("doc_id"), "text"), shingle=5, percent=80)
    least = groups.where("doc_id = component_id").select(F.col("doc_id").alias(node)).distinct()
    kept = noded.join(least.hint("shuffle_hash"), node)
    once = kept.where(F.col(node) >= NODE).dropDuplicates([node])
    return kept.where(F.col(node) < NODE).unionByName(once).unionByName(noded.where(F.col(node).isNull())).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each live secret replaced by a mark and n_chars counted anew; widely copied examples stay.

    Null and empty texts pass unchanged; repeated rows are redacted alike; texts of any length are scanned whole; an empty
    table stays empty.
    """
    key, cuts = fresh("key", docs.columns), fresh("cuts", docs.columns)
    hashed = docs.withColumn(key, F.concat_ws(":", F.xxhash64("text"), F.xxhash64(F.lit(8), "text"), F.col("doc_id")))
    found = scan_secrets(hashed, keep=(key,), shared=EXAMPLE_OWNERS)
    spans = F.filter("spans", lambda s: s["status"] == "live")
    found = found.select(key, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(cuts))
    found = found.where(F.size(cuts) > 0).dropDuplicates([key])
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            for i, spans in enumerate(batch.column(cuts).to_pylist()):
                if spans:
                    texts[i] = redact(texts[i], [(s["start"], s["end"]) for s in spans])
                    chars[i] = len(texts[i])
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(chars, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    return hashed.join(found.hint("shuffle_hash"), key, "left").select(*names, cuts).mapInArrow(cut, docs.schema)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have no words and are only taken with their source's complete epochs; the null source is a source; equal
    rows of which the budget takes a part are taken in that number; texts of any length count whole; an empty table stays empty.
    """
    key, least, more, times, nth = (fresh(c, docs.columns) for c in ("key", "least", "more", "times", "nth"))
    plan = mix_sources(docs).select(F.xxhash64("doc_id", "text_hash", "source").alias(key), "times")
    plan = plan.groupBy(key).agg(F.min("times").alias(least), (F.sum("times") - F.count("*") * F.min("times")).alias(more), (F.max("times") > F.min("times")).alias(times))
    taken = docs.withColumn(key, F.xxhash64("doc_id", F.xxhash64("text"), F.col("source").cast("string"))).join(plan.where(f"`{least}` > 0 or `{more}` > 0").hint("shuffle_hash"), key)
    # the budget of a source ends in one group of equal rows at most
    order = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    split = taken.where(times).withColumn(times, F.col(least) + (F.row_number().over(order) <= F.col(more)).cast("long"))
    whole = taken.where(~F.col(times)).withColumn(times, F.col(least))
    taken = whole.unionByName(split).where(F.col(times) > 0)
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens.

    A null or empty text is the end id alone; repeated rows are packed each; longer texts are cut, none is shortened; an
    empty table gives no pieces.
    """
    return pack_documents(docs, public_tokenizers.path(TOKEN_RANKS), keep_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, work in STAGES:
        docs = stage(work(spark, docs, sf_dir))
    return docs
