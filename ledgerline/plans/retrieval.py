"""Literature retrieval: `documents` is the corpus, `benchmark.text` the questions.

A document's title is its first sentence, its category `lang`, its journal `source`, its year 2015 + doc_id mod 10; its vector and a
question's are those of `embeddings` with the same number.
Questions are keyed by item_id throughout, so that a batch of them is one job.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.expressions import significant_words
from ledgerline.functions.neighbours import greatest_products
from ledgerline.functions.scan import best_documents, set_vectors
from ledgerline.plans.evidence import _ANS, answers
from ledgerline.registry import query
from ledgerline.sources.files import written
from ledgerline.sources.tables import read


@query("g19_corpus_stats", "SELECT lang, count(*)::BIGINT AS n, min(n_chars) AS shortest, max(n_chars) AS longest, count(DISTINCT source)::BIGINT AS sources FROM documents GROUP BY lang")
def corpus_stats(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.count_distinct("source").alias("sources"))


@query("g2_document_frequency", "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents) SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term")
def document_frequency(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


#: Stop words of the index; a parameter.
STOP = ("the", "and", "of", "to", "in", "is", "that", "it", "for", "on", "as", "with", "at", "by", "an", "be", "this", "are", "from", "or")
#: Categories that a word of the question favours, and the pair that holds without such a word; a parameter.
INTENT = {"that": ("en", "de"), "the": ("en",), "der": ("de",), "que": ("es", "fr"), "les": ("fr",), "los": ("es",)}
DEFAULT_INTENT = ("en", "fr")
_STOP = ", ".join(f"'{w}'" for w in STOP)
#: Terms in the index, hits of a question; parameters.
VOCABULARY, HITS = 10000, 5
#: Terms that a task holds while it counts.
HELD = 1 << 19


def _terms(table, key):
    words = f"list_filter(regexp_extract_all(lower(text), '[a-z]{{2,}}'), lambda x: x NOT IN ({_STOP}))"
    return f"(SELECT {key}, term, count(*) AS f FROM (SELECT {key}, unnest(w) AS term FROM (SELECT {key}, {words} AS w FROM {table}) UNION ALL SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM (SELECT {key}, {words} AS w FROM {table})) GROUP BY 1, 2)"


_TFIDF = f"""n AS (SELECT count(*) AS n FROM documents), tf AS {_terms("documents", "doc_id")}, v AS (SELECT term, ln((1 + max(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf, n GROUP BY 1 HAVING count(*) <= 0.9 * max(n) ORDER BY sum(f) DESC, term LIMIT {VOCABULARY})
    , w AS (SELECT doc_id, term, f * idf AS w FROM tf JOIN v USING (term)), norm AS (SELECT doc_id, count(*)::BIGINT AS terms, sqrt(sum(w * w)) AS s FROM w GROUP BY 1)
    , q AS (SELECT item_id, term, f * idf AS w FROM {_terms("benchmark", "item_id")} JOIN v USING (term)), qnorm AS (SELECT item_id, sqrt(sum(w * w)) AS s FROM q GROUP BY 1)
    , s AS (SELECT item_id, doc_id, round(sum(w.w * q.w) / (max(norm.s) * max(qnorm.s)), 6) AS score FROM q JOIN w USING (term) JOIN norm USING (doc_id) JOIN qnorm USING (item_id) GROUP BY 1, 2)
    , r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM s WHERE score > 0), hits AS (SELECT item_id, doc_id, score, rank FROM r WHERE rank <= {HITS})"""


def spread(t: DataFrame) -> DataFrame:
    """t over all cores, where its files are too few to keep them busy; a large table stays as it is scanned."""
    cores = t.sparkSession.sparkContext.defaultParallelism
    return t.repartition(cores) if t.rdd.getNumPartitions() < cores else t


_TOKEN = re.compile("[a-z]{2,}")


def _terms_of(text: str | None) -> Counter[str]:
    """How often a text holds each single word (two letters or more, no stop word) and each pair of neighbouring ones."""
    w = _words_and_pairs(text)
    return Counter(w)


_LEFT_OUT = frozenset(STOP)


def _words_and_pairs(text: str | None) -> list[str]:
    w = [x for x in _TOKEN.findall((text or "").lower()) if x not in _LEFT_OUT]
    return w + list(map(" ".join, pairwise(w)))


def term_totals(t: DataFrame) -> DataFrame:
    """(term, df, cf): texts that hold a term, and its occurrences. Texts are counted where they are; HELD terms of a task at most wait to be summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        cf: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(df.values(), pa.int64()), pa.array([cf[w] for w in df], pa.int64())], names=["term", "df", "cf"])
            df.clear()
            cf.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                w = _words_and_pairs(text.as_py())
                cf.update(w)
                df.update(set(w))
                if len(df) > HELD:
                    yield out()
        yield out()

    return t.select("text").mapInArrow(count, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_counts(t: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """(key, term, f) of the terms of a vocabulary, which has VOCABULARY rows at most."""
    known = t.sparkSession.sparkContext.broadcast({r["term"] for r in vocabulary.select("term").collect()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                own = [[(w, n) for w, n in _terms_of(text.as_py()).items() if w in known.value] for text in part.column(1)]
                at = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array([w for x in own for w, _ in x], pa.string()), pa.array([n for x in own for _, n in x], pa.int64())], names=[key, "term", "f"])

    return t.select(key, "text").mapInArrow(count, f"{key} long, term string, f long").groupBy(key, "term").agg(F.sum("f").alias("f"))


def vocabulary_of(docs: DataFrame) -> DataFrame:
    """(term, idf): the VOCABULARY most frequent terms that at most nine tenths of the documents hold."""
    n = docs.agg(F.count_distinct("doc_id").alias("n"))  # one row
    v = term_totals(docs).crossJoin(F.broadcast(n)).where("df <= 0.9D * n")
    return v.orderBy(F.desc("cf"), "term").limit(VOCABULARY).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def texts_of(docs: DataFrame, value: str = "text") -> DataFrame:
    """(doc_id, texts): the texts of each id, which are one row's unless an id is repeated. Only ids are shuffled, and the repeated ones' texts."""
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")))
    one = docs.select("doc_id", F.array(value).alias("texts"))
    if repeated.isEmpty():
        return one
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    more = docs.join(repeated, same).groupBy("doc_id").agg(F.collect_list(value).alias("texts"))
    return one.join(repeated, same, "left_anti").unionByName(more)


def tfidf_vectors(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, terms, norm, ids, w): of each document with terms of a vocabulary(number, term, idf), which has VOCABULARY rows at most, their number,
    the length of their weights, and the unit vector, packed. Every document is read and packed where it is."""
    rows = vocabulary.collect()
    known = docs.sparkSession.sparkContext.broadcast(({r["term"]: r["number"] for r in rows}, np.array([r["idf"] for r in sorted(rows, key=lambda r: r["number"])])))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, idf = known.value
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                keep, terms, norm, ids, weights = [], [], [], [], []
                for i, texts in enumerate(part.column(1).to_pylist()):
                    own = [number[w] for text in texts for w in _words_and_pairs(text) if w in number]
                    if own:
                        at, f = np.unique(np.array(own, np.int32), return_counts=True)
                        w = f * idf[at]
                        keep.append(i)
                        terms.append(at.size)
                        norm.append(np.sqrt((w * w).sum()))
                        ids.append(at.tobytes())
                        weights.append((w / norm[-1]).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(terms, pa.int64()), pa.array(norm, pa.float64()), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], names=["doc_id", "terms", "norm", "ids", "w"])

    return texts_of(docs).mapInArrow(pack, "doc_id long, terms long, norm double, ids binary, w binary")


#: Indexes of this process by application, folder and state of the corpus: built once, read by every query on it.
_STORED: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def tfidf_store(spark, d) -> tuple[DataFrame, DataFrame]:
    """The stored index of a corpus: its vocabulary (number, term, idf), and its documents' packed unit vectors with their terms and norms."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    state = tuple(docs.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first())
    key = (spark.sparkContext.applicationId, d, state)
    if key not in _STORED:
        terms = sorted((r["term"], r["idf"]) for r in vocabulary_of(docs).collect())  # VOCABULARY rows
        v = spark.createDataFrame([(i, term, idf) for i, (term, idf) in enumerate(terms)], "number int, term string, idf double")
        _STORED[key] = v, written(tfidf_vectors(docs, v))
    return _STORED[key]


def best_of(scores: DataFrame, key: str, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each key with their rank. Spark applies the limit in each task before rows meet by key, and again after."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie)).cast("long")
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


@query("g3_tfidf_top", f"WITH {_TFIDF} SELECT * FROM hits")
def tfidf_top(spark, d):
    """Cosine of TF-IDF vectors: documents and questions in one index, positive scores only."""
    v, vectors = tfidf_store(spark, d)
    q = term_counts(read(spark, d, "benchmark").select("item_id", "text"), "item_id", v).join(F.broadcast(v), "term").select("item_id", "number", (F.col("f") * F.col("idf")).alias("w"))  # VOCABULARY rows
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("item_id")))  # a question's terms
    return best_documents(vectors, q.select("item_id", F.col("number").alias("term"), (F.col("w") / norm).alias("qw")), HITS)


WORDS = r"[\p{L}\p{N}_]+"


def words_of(c: Column, longer: int) -> Column:
    """Distinct lower-cased words of more than so many characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(WORDS), 0), lambda w: F.length(w) > longer))


def _words(c, longer):
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '{WORDS}'), lambda w: length(w) > {longer}))"


@query("g1_index_text", "SELECT doc_id, md5(concat_ws(' ', regexp_extract(text, '^[^.]*'), text, substr(text, 1, 2000), lang, source)) AS h FROM documents")
def index_text(spark, d):
    """The text that is embedded: title, abstract (the whole text), its first 2000 characters, keywords."""
    joined = F.concat_ws(" ", F.regexp_extract("text", r"^[^.]*", 0), "text", F.substring("text", 1, 2000), "lang", "source")
    return read(spark, d, "documents").select("doc_id", F.md5(joined).alias("h"))


@query("g2_tfidf_index", f"WITH {_TFIDF} SELECT doc_id, terms, round(s, 5) AS norm FROM norm")
def tfidf_index(spark, d):
    """Terms and norm of each document in the index."""
    return tfidf_store(spark, d)[1].select("doc_id", "terms", F.round("norm", 5).alias("norm"))


@query("g4_dense_top", """WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), q AS (SELECT label AS query, list(x ORDER BY i) AS q FROM c GROUP BY 1),
    s AS (SELECT query, vec_id, round(list_inner_product(q, embedding::DOUBLE[]), 6) AS score FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::BIGINT AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def dense_top(spark, d):
    """The five nearest vectors to the mean vector of each label, by inner product."""
    e = read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    q = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("q")).withColumnRenamed("label", "query")
    found = greatest_products(e.select(F.col("vec_id").alias("id"), F.col("v").alias("x")), q.select(F.col("query").cast("long").alias("id"), F.col("q").alias("x")), 5)
    return found.select(F.col("query").cast("int").alias("query"), F.col("id").alias("vec_id"), "score", "rank")


_KEY = r"""qw AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS word FROM benchmark), qn AS (SELECT item_id, count(*) AS words FROM qw GROUP BY 1),
    kd AS (SELECT doc_id, lower(regexp_extract(text, '^[^.]*') || ' ' || text) AS body FROM documents WHERE text IS NOT NULL), ka AS (SELECT item_id, doc_id, round(count(*)::DOUBLE / max(words), 6) AS score FROM qw JOIN kd ON contains(body, word) JOIN qn USING (item_id) GROUP BY 1, 2),
    ks AS (SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM ka) WHERE place <= 20)"""
GRAM = 3
#: Tokens that a task remembers.
KNOWN = 1 << 17
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def keyword_scores(spark, d, k: int = 20) -> DataFrame:
    """Share of a question's words that occur anywhere within a document's title and text; the k best documents of each question.

    A word without a blank is contained in a text if one of the text's tokens contains it. A word waits under its first GRAM characters; each
    different token looks at all of its own places there, once in a task as long as it is among the last KNOWN ones.
    """
    qw = written(read(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''").groupBy("item_id", "word").agg(F.count("*").alias("times")))
    body = F.lower(F.concat(F.regexp_extract("text", r"^[^.]*", 0), F.lit(" "), F.col("text")))
    asked = sorted(r["word"] for r in qw.select("word").distinct().collect())  # a batch's words
    numbers = spark.createDataFrame(list(enumerate(asked)), "term int, word string")
    given = spark.sparkContext.broadcast(asked)

    def contained():
        waiting: dict[str, list[tuple[str, int]]] = {}
        for i, w in enumerate(given.value):
            waiting.setdefault(w[:GRAM], []).append((w, i))
        known: dict[str, frozenset[int]] = {}

        def of(token: str) -> frozenset[int]:
            found = known.get(token)
            if found is None:
                if len(known) > KNOWN:
                    known.clear()
                found = known[token] = frozenset(n for i in range(len(token)) for g in range(1, min(GRAM, len(token) - i) + 1) for w, n in waiting.get(token[i : i + g], ()) if token.startswith(w, i))
            return found

        return lambda texts: set().union(*(of(t) for t in {t for x in texts for t in _BLANK.split(x)}))

    docs = spread(read(spark, d, "documents").where("text IS NOT NULL")).select("doc_id", body.alias("body"))
    found = best_documents(set_vectors(texts_of(docs, "body"), contained), qw.join(F.broadcast(numbers), "word").select("item_id", "term", F.col("times").cast("double").alias("qw")), k)
    words = qw.groupBy("item_id").agg(F.sum("times").alias("words"))
    return found.join(words, "item_id").select("item_id", "doc_id", F.round(F.col("score") / F.col("words"), 6).alias("score"))


@query("g6_keyword_fallback", f"WITH {_KEY} SELECT item_id, doc_id, score FROM ks")
def keyword_fallback(spark, d):
    return keyword_scores(spark, d)


_DENSE = """unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings WHERE list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) > 0),
    da AS (SELECT b.item_id, e.vec_id AS doc_id, round(list_inner_product(q.v, e.v), 6) AS score FROM benchmark b JOIN unit q ON q.vec_id = b.item_id JOIN unit e ON e.vec_id <> b.item_id JOIN (SELECT DISTINCT doc_id FROM documents) x ON x.doc_id = e.vec_id),
    ds AS (SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM da WHERE score >= 0.3) WHERE place <= 20)"""


def dense_scores(spark, d, k: int = 20, least: float = 0.3) -> DataFrame:
    """The k documents of each question with the greatest inner product of unit vectors, of `least` or more.

    A question's vector and a document's are those of `embeddings` with its number.
    """
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
    unit = e.withColumn("n", norm).where("n > 0").select("vec_id", F.transform("x", lambda x: x / F.col("n")).alias("v"))
    q = read(spark, d, "benchmark").join(unit, F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query"), F.col("v").alias("q"))
    docs = unit.join(read(spark, d, "documents").select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id")
    # a question's own vector may be among its best
    found = greatest_products(docs.select(F.col("vec_id").alias("id"), F.col("v").alias("x")), q.select(F.col("query").alias("id"), F.col("q").alias("x")), k + 1)
    s = found.where((F.col("query") != F.col("id")) & (F.col("score") >= least))
    return best_of(s.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "score"), "item_id", k).drop("rank")


@query("g5_hybrid_merge", f"WITH {_TFIDF}, {_DENSE}, few AS (SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM ds GROUP BY 1 HAVING count(*) >= 10)) SELECT item_id, doc_id, score FROM ds UNION ALL SELECT item_id, doc_id, round(score * 0.8, 6) FROM hits WHERE item_id IN (SELECT * FROM few) AND (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM ds)")
def hybrid_merge(spark, d, k: int = 20):
    """Dense hits; where a question has fewer than k / 2 of them, TF-IDF hits that are not among them at 0.8 of their score."""
    p = written(dense_scores(spark, d, k))
    enough = p.groupBy("item_id").agg(F.count("*").alias("n")).where(F.col("n") >= k // 2)
    more = tfidf_top(spark, d).join(enough, "item_id", "left_anti").join(p, ["item_id", "doc_id"], "left_anti")
    return p.unionByName(more.select("item_id", "doc_id", F.round(F.col("score") * 0.8, 6).alias("score")))


_INTENT = "intent AS (SELECT item_id, text, list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {list(v)} ELSE [] END" for k, v in INTENT.items()) + f"]))) AS found FROM benchmark), cats AS (SELECT item_id, text, CASE WHEN len(found) = 0 THEN {list(DEFAULT_INTENT)} ELSE found END AS cats FROM intent)"


def intents(t: DataFrame) -> DataFrame:
    """Adds cats, the categories that a question favours."""
    low = F.lower("text")
    none = F.array().cast("array<string>")
    favoured = F.concat(*(F.when(F.contains(low, F.lit(k)), F.array(*(F.lit(x) for x in v))).otherwise(none) for k, v in INTENT.items()))
    distinct = F.array_sort(F.array_distinct(favoured))
    return t.withColumn("cats", F.when(F.size(distinct) == 0, F.array(*(F.lit(x) for x in DEFAULT_INTENT))).otherwise(distinct))


@query("g10_query_intent", f"WITH {_INTENT} SELECT item_id, array_to_string(cats, ';') AS cats FROM cats")
def query_intent(spark, d):
    return intents(read(spark, d, "benchmark")).select("item_id", F.array_join("cats", ";").alias("cats"))


_RERANK = f"""{_TFIDF}, {_INTENT}, full_ AS (SELECT h.item_id, h.doc_id, h.score, b.text AS q, d.text AS t, d.lang, d.source, 2015 + h.doc_id % 10 AS year, b.cats FROM hits h JOIN cats b USING (item_id) JOIN documents d USING (doc_id)),
    rs AS (SELECT *, round(0.6 * score + 0.2 * len(list_intersect({_words('q', 2)}, {_words('t', 2)})) / greatest(1, len({_words('q', 2)})) + CASE WHEN year >= 2020 THEN least(0.2, 0.05 * (year - 2019)) ELSE 0 END + CASE WHEN list_contains(cats, lang) THEN 0.15 ELSE 0 END, 6)::DOUBLE AS final FROM full_),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id)::BIGINT AS place FROM rs)"""


def reranked(spark, d) -> DataFrame:
    """TF-IDF hits with their texts and a final score from score, word overlap, recency and category; place is the rank."""
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("t"), "lang", "source", (2015 + F.col("doc_id") % 10).alias("year"))
    t = tfidf_top(spark, d).drop("rank").join(intents(read(spark, d, "benchmark")).withColumnRenamed("text", "q"), "item_id").join(docs, "doc_id")
    q, w = words_of(F.col("q"), 2), words_of(F.col("t"), 2)
    overlap = F.size(F.array_intersect(q, w)) / F.greatest(F.lit(1), F.size(q))
    recency = F.when(F.col("year") >= 2020, F.least(F.lit(0.2), 0.05 * (F.col("year") - 2019))).otherwise(0.0)
    final = 0.6 * F.col("score") + 0.2 * overlap + recency + F.when(F.array_contains("cats", F.col("lang")), 0.15).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("final"), "doc_id")).cast("long")
    return t.withColumn("final", F.round(final, 6)).withColumn("place", place)


@query("g7_rerank", f"WITH {_RERANK} SELECT item_id, doc_id, final, place FROM reranked")
def rerank(spark, d):
    return reranked(spark, d).select("item_id", "doc_id", "final", "place")


_HIGH = f"""{_RERANK}, sents AS (SELECT item_id, doc_id, place, final, unnest(string_split(regexp_replace(t, '([.!?])[ \t\n\r]+', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(t, '([.!?])[ \t\n\r]+', '\\1' || chr(1), 'g'), chr(1)), 1) AS pos, {_words('q', 3)} AS kw FROM reranked),
    scored AS (SELECT *, len(list_filter(kw, lambda k: contains(lower(s), k))) AS n FROM sents), best AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n DESC, pos)::BIGINT AS nth FROM scored WHERE n > 0), lights AS (SELECT item_id, doc_id, place, final, s, n, nth FROM best WHERE nth <= 2 UNION ALL SELECT item_id, doc_id, place, final, substr(t, 1, 300), 0, 1 FROM reranked WHERE (item_id, doc_id) NOT IN (SELECT (item_id, doc_id) FROM best))"""


def highlights(spark, d) -> DataFrame:
    """The two sentences of each hit with most of the question's words, in order of hits, then of place in the text; without
    any such sentence the text's first 300 characters."""
    pieces = F.split("t", r"(?<=[.!?])[ \t\n\r]+")
    kw = words_of(F.col("q"), 3)
    each = F.transform(pieces, lambda s, i: F.struct((-F.size(F.filter(kw, lambda k: F.contains(F.lower(s), k)))).alias("down"), i.alias("pos"), s.alias("s")))
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["down"] < 0)), 1, 2)
    none = F.array(F.struct(F.lit(0).alias("down"), F.lit(0).alias("pos"), F.substring("t", 1, 300).alias("s")))
    t = reranked(spark, d).withColumn("best", best)
    s = t.select("item_id", "doc_id", "place", "final", F.posexplode(F.when(F.size("best") > 0, F.col("best")).otherwise(none)).alias("at", "b"))
    return s.select("item_id", "doc_id", "place", "final", F.col("b.s").alias("s"), (-F.col("b.down")).alias("n"), (F.col("at") + 1).cast("long").alias("nth"))


@query("g8_highlights", f"WITH {_HIGH} SELECT item_id, doc_id, nth, n::BIGINT AS hits, s AS sentence FROM lights")
def highlight_rows(spark, d):
    return highlights(spark, d).select("item_id", "doc_id", "nth", F.col("n").cast("long").alias("hits"), F.col("s").alias("sentence"))


@query("g9_batch_retrieval", f"WITH {_TFIDF} SELECT item_id, count(*)::BIGINT AS hits, max(score) AS best FROM hits GROUP BY 1")
def batch_retrieval(spark, d):
    return tfidf_top(spark, d).groupBy("item_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


@query("g11_context_blocks", f"WITH {_RERANK} SELECT item_id, md5(string_agg('[REF_' || doc_id || '] ' || lang || ', ' || year || chr(10) || t, chr(10) || chr(10) ORDER BY place)) AS h FROM reranked GROUP BY 1")
def context_blocks(spark, d):
    """One context text per question: its hits in order, each with its id. At most five texts a question."""
    block = F.concat(F.lit("[REF_"), F.col("doc_id").cast("string"), F.lit("] "), "lang", F.lit(", "), F.col("year").cast("string"), F.lit("\n"), "t")
    blocks = reranked(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("b"))
    return blocks.select("item_id", F.md5(F.array_join("b.block", "\n\n")).alias("h"))


@query("g12_extractive_answer", f"WITH {_HIGH} SELECT item_id, string_agg(s || ' [REF_' || doc_id || ']', ' ' ORDER BY place) || ' See [REF_0].' AS answer FROM lights WHERE nth = 1 AND place <= 4 GROUP BY 1")
def extractive_answer(spark, d):
    part = F.concat("s", F.lit(" [REF_"), F.col("doc_id").cast("string"), F.lit("]"))
    a = highlights(spark, d).where("nth = 1 AND place <= 4").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("p")))).alias("a"))
    return a.select("item_id", F.concat(F.array_join("a.p", " "), F.lit(" See [REF_0].")).alias("answer"))


_CITE = f"{_ANS}, refs AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(answer || ' [REF_' || (conv_id * 37) || ']', '\\[REF_([0-9]+)\\]', 1))::BIGINT AS ref FROM answers), corpus AS (SELECT doc_id, any_value(source) AS source FROM documents GROUP BY 1), checked AS (SELECT conv_id, turn, ref, source, doc_id IS NOT NULL AS valid FROM refs LEFT JOIN corpus ON doc_id = ref)"


def checked(spark, d) -> DataFrame:
    """Distinct citations of each answer, with whether the corpus has them."""
    text = F.concat("answer", F.lit(" [REF_"), (F.col("conv_id") * 37).cast("string"), F.lit("]"))
    refs = answers(spark, d).select("conv_id", "turn", F.explode(F.regexp_extract_all(text, F.lit(r"\[REF_([0-9]+)\]"), 1)).alias("ref")).withColumn("ref", F.col("ref").cast("long")).distinct()
    corpus = read(spark, d, "documents").groupBy(F.col("doc_id").alias("ref")).agg(F.min("source").alias("source"), F.lit(True).alias("known"))
    return refs.join(corpus, "ref", "left").select("conv_id", "turn", "ref", "source", F.col("known").isNotNull().alias("valid"))


@query("g13_citations", f"WITH {_CITE} SELECT conv_id, turn, count(*)::BIGINT AS cited FROM checked GROUP BY 1, 2")
def citations(spark, d):
    return checked(spark, d).groupBy("conv_id", "turn").agg(F.count("*").alias("cited"))


@query("g14_citation_check", f"WITH {_CITE} SELECT conv_id, turn, coalesce(string_agg(ref::VARCHAR, ';' ORDER BY ref) FILTER (valid), '') AS valid, coalesce(string_agg(ref::VARCHAR, ';' ORDER BY ref) FILTER (NOT valid), '') AS invalid, bool_and(valid) AS passed FROM checked GROUP BY 1, 2")
def citation_check(spark, d):
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("ref")))).cast("array<string>"), ";")
    return checked(spark, d).groupBy("conv_id", "turn").agg(ids(F.col("valid")).alias("valid"), ids(~F.col("valid")).alias("invalid"), F.bool_and("valid").alias("passed"))


@query("g15_bibliography", f"WITH {_CITE} SELECT conv_id, turn, ref, source AS journal, 2015 + ref % 10 AS year FROM checked WHERE valid")
def bibliography(spark, d):
    return checked(spark, d).where("valid").select("conv_id", "turn", "ref", F.col("source").alias("journal"), (2015 + F.col("ref") % 10).alias("year"))


@query("g16_answer_confidence", f"WITH {_HIGH} SELECT r.item_id, round(least(0.95, 0.6 * avg(r.final) + 0.4 * count(l.doc_id) / count(*)), 5) AS confidence FROM reranked r LEFT JOIN (SELECT item_id, doc_id FROM lights WHERE nth = 1 AND place <= 4) l ON l.item_id = r.item_id AND l.doc_id = r.doc_id GROUP BY 1")
def answer_confidence(spark, d):
    """From the mean score and the share of hits that the extractive answer cites (those with a highlight, four at most)."""
    t = highlights(spark, d).where("nth = 1")
    c = 0.6 * F.avg("final") + 0.4 * F.count_if(F.col("place") <= 4) / F.count("*")
    return t.groupBy("item_id").agg(F.round(F.least(F.lit(0.95), c), 5).alias("confidence"))


@query("g17_abstention", f"WITH {_KEY} SELECT item_id, CASE WHEN count(doc_id) = 0 THEN 'no evidence' ELSE 'answered' END AS state FROM benchmark LEFT JOIN (SELECT * FROM ks WHERE score >= 0.2) USING (item_id) GROUP BY 1")
def abstention(spark, d):
    """Questions without any hit of 0.2 or more are answered by an abstention."""
    n = keyword_scores(spark, d).where("score >= 0.2").groupBy("item_id").agg(F.count("*").alias("n"))
    return read(spark, d, "benchmark").select("item_id").join(n, "item_id", "left").select("item_id", F.when(F.col("n").isNull(), "no evidence").otherwise("answered").alias("state"))


@query("g18_corpus_filters", f"SELECT doc_id FROM documents WHERE lang = 'en' AND list_contains({_words('text', 0)}, 'the') AND len(list_filter([source, lang], lambda s: contains(lower(s), 's'))) > 0")
def corpus_filters(spark, d, category: str | None = "en", compound: str | None = "The", plant: str | None = "S"):
    """Documents of a category, with a compound (an equal word of the text, in any case) and a plant (within an element of an array)."""
    t = read(spark, d, "documents")
    if category is not None:
        t = t.where(F.col("lang") == category)
    if compound is not None:
        t = t.where(F.array_contains(words_of(F.col("text"), 0), compound.lower()))
    if plant is not None:
        t = t.where(F.exists(F.array("source", "lang"), lambda s: F.contains(F.lower(s), F.lit(plant.lower()))))
    return t.select("doc_id")


@query("g20_word_overlap", f"""WITH q AS (SELECT DISTINCT item_id, unnest({_words('text', 0)}) AS w FROM benchmark), t AS (SELECT DISTINCT doc_id, unnest({_words('text', 0)}) AS w FROM documents), s AS (SELECT item_id, doc_id, count(*)::BIGINT AS n FROM q JOIN t USING (w) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id)::BIGINT AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def word_overlap(spark, d):
    """The five documents that share most distinct words with each question."""
    q = written(read(spark, d, "benchmark").select("item_id", F.explode(words_of(F.col("text"), 0)).alias("word")).distinct())
    asked = sorted(r["word"] for r in q.select("word").distinct().collect())  # a batch's words
    numbers = spark.createDataFrame(list(enumerate(asked)), "term int, word string")
    given = spark.sparkContext.broadcast({w: i for i, w in enumerate(asked)})
    docs = spread(read(spark, d, "documents")).select("doc_id", F.filter(words_of(F.col("text"), 0), lambda w: F.length(w) > 0).alias("words"))
    of = lambda: lambda texts: {given.value[w] for words in texts for w in words or () if w in given.value}
    found = best_documents(set_vectors(texts_of(docs, "words"), of), q.join(F.broadcast(numbers), "word").select("item_id", "term", F.lit(1.0).alias("qw")), 5)
    return found.select("item_id", "doc_id", F.col("score").cast("long").alias("n"), "rank")


@query("g21_query_table", "WITH c AS (SELECT 'evidence for ' || p_name || ' ' || p_partkey AS question, 2 AS part, p_retailprice, p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3) SELECT question FROM (SELECT 'mechanism of action' AS question UNION ALL SELECT 'safety profile' UNION ALL SELECT 'binding affinity' UNION ALL SELECT question FROM c)")
def query_table(spark, d):
    """Three default questions and one for each of the three best candidates, six at most."""
    default = spark.range(1).select(F.explode(F.array(*(F.lit(q) for q in ("mechanism of action", "safety profile", "binding affinity")))).alias("question"))
    top = read(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(3)
    return default.unionByName(top.select(F.concat(F.lit("evidence for "), "p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("question")))
