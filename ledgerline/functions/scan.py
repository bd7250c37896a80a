"""The best documents of a batch of questions in one scan of stored sparse vectors. Exact, without a shuffle of what is scored.

Every task scores its documents against all questions (AT_ONCE at a time) and keeps the k best of each; only those meet. The work is that of
documents times questions, whatever the vectors; what a task holds is a stretch of documents and the questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.files import written

#: Questions of one scan; numbers that one step multiplies.
AT_ONCE, STEP = 1024, 1 << 20
#: A document: its number, its terms' numbers (int32) and weights (double).
VECTOR = "doc_id long, ids binary, w binary"


class Best:
    """The k best (score, doc) of each question, scores as whole numbers of the last digit, ties to the smaller doc."""

    def __init__(self, questions: int, k: int) -> None:
        self.n, self.k = questions, k
        self.q, self.r, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.edge_r, self.edge_doc = np.zeros(questions, np.int64), np.full(questions, np.iinfo(np.int64).min)  # scores over 0 only

    def add(self, r: np.ndarray, doc: np.ndarray) -> None:
        """r: documents by questions."""
        at, q = np.nonzero((r > self.edge_r) | ((r == self.edge_r) & (doc[:, None] < self.edge_doc)))
        if not q.size:
            return
        q, r, doc = np.concatenate([self.q, q]), np.concatenate([self.r, r[at, q]]), np.concatenate([self.doc, doc[at]])
        order = np.lexsort((doc, -r, q))
        q, r, doc = q[order], r[order], doc[order]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(q.size) - first[q] < self.k
        self.q, self.r, self.doc = q[keep], r[keep], doc[keep]
        count = np.bincount(self.q, minlength=self.n)
        full = np.flatnonzero(count == self.k)
        last = np.cumsum(count)[full] - 1
        self.edge_r[full], self.edge_doc[full] = self.r[last], self.doc[last]


def best_documents(vectors: DataFrame, questions: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """vectors(VECTOR), questions(item_id, term, qw) with terms as numbers and one row for each pair → item_id, doc_id, score, rank: the k greatest
    rounded sums of qw * w over 0, ties to the smaller doc_id. The questions of a batch are broadcast."""
    rows = questions.where("item_id IS NOT NULL").select("item_id", "term", "qw").toArrow()  # a batch's questions
    item, term, qw = (rows.column(c).to_numpy() for c in ("item_id", "term", "qw"))
    items, number = np.unique(item, return_inverse=True)
    parts = [_scanned(vectors, items[a : a + AT_ONCE], *(v[(number >= a) & (number < a + AT_ONCE)] for v in (number - a, term, qw)), k, digits) for a in range(0, max(1, items.size), AT_ONCE)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _scanned(vectors: DataFrame, items: np.ndarray, number: np.ndarray, term: np.ndarray, qw: np.ndarray, k: int, digits: int) -> DataFrame:
    used, column = np.unique(term, return_inverse=True)
    asked = vectors.sparkSession.sparkContext.broadcast((items, used, number, column, qw))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, used, number, column, qw = asked.value
        matrix = np.zeros((used.size, items.size))
        matrix[column, number] = qw
        best, unit = Best(items.size, k), 10.0**digits
        at = np.full(int(used.max(initial=-1)) + 2, -1)
        at[used] = np.arange(used.size)
        rows = max(1, STEP // max(1, items.size))
        for batch in batches:
            docs, each = batch.column("doc_id").to_numpy(), [np.frombuffer(v.as_py(), np.int32) for v in batch.column("ids")]
            w = np.frombuffer(b"".join(v.as_py() for v in batch.column("w")))
            row = np.repeat(np.arange(len(each)), [len(x) for x in each])
            own = at[np.minimum(np.concatenate([*each, np.zeros(0, np.int32)]), at.size - 1)]  # only the questions' terms matter
            known = np.flatnonzero(own >= 0)
            row, own, w = row[known], own[known], w[known]
            heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if row.size else row
            ends = np.append(heads[1:], row.size)
            a = 0
            while a < heads.size:  # whole documents, about STEP products
                b = max(a + 1, int(np.searchsorted(ends, heads[a] + rows, "right")))
                x, y = heads[a], ends[b - 1]
                s = np.add.reduceat(matrix[own[x:y]] * w[x:y, None], heads[a:b] - x, axis=0)
                best.add(np.floor(s * unit + 0.5).astype(np.int64), docs[row[heads[a:b]]])
                a = b
        yield pa.RecordBatch.from_arrays([pa.array(items[best.q], pa.int64()), pa.array(best.doc, pa.int64()), pa.array(best.r / unit, pa.float64())], names=["item_id", "doc_id", "score"])

    return vectors.where("doc_id IS NOT NULL").select("doc_id", "ids", "w").mapInArrow(scan, "item_id long, doc_id long, score double")


def set_vectors(t: DataFrame, numbers: Callable[[], Callable[[object], set[int]]]) -> DataFrame:
    """t(doc_id, one column more) → VECTOR with weights of 1. numbers makes, in each task, what turns the other column's value into the numbers of its terms."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = numbers()
        for batch in batches:
            for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                own = [sorted(of(v.as_py())) for v in part.column(1)]
                keep = np.array([i for i, x in enumerate(own) if x], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array([np.array(own[i], np.int32).tobytes() for i in keep], pa.binary()), pa.array([np.ones(len(own[i])).tobytes() for i in keep], pa.binary())], names=["doc_id", "ids", "w"])

    return t.mapInArrow(pack, VECTOR)


def greatest_likeness(sets: DataFrame, questions: DataFrame, above: tuple[int, int]) -> DataFrame:
    """sets(doc_id, terms array<string>), questions(item_id, terms), terms distinct → item_id, most, n: of the documents that share a term with a question the
    greatest Jaccard similarity, and the number of those over the fraction `above`. Rows of one number are one set. Exact; a batch's questions are broadcast.
    """
    numbered = questions.where("item_id IS NOT NULL").select("item_id", F.explode("terms").alias("term")).distinct().toArrow()  # a batch's questions
    item, term = numbered.column("item_id").to_numpy(), numbered.column("term").combine_chunks()
    items, number = np.unique(item, return_inverse=True)
    sets = _whole(sets.where("doc_id IS NOT NULL").select("doc_id", "terms")).select("terms")
    parts = []
    for a in range(0, max(1, items.size), AT_ONCE):
        own = np.flatnonzero((number >= a) & (number < a + AT_ONCE))
        parts.append(_likest(sets, items[a : a + AT_ONCE], number[own] - a, term.take(pa.array(own)), above))
    return reduce(DataFrame.unionByName, parts).groupBy("item_id").agg(F.max("most").alias("most"), F.sum("n").alias("n"))


def _whole(sets: DataFrame) -> DataFrame:
    """One row for each doc_id: only rows whose number is repeated are shuffled."""
    more = written(sets.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not more.count():
        return sets
    more = more.hint("merge")
    joined = sets.join(more, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    return sets.join(more, "doc_id", "left_anti").unionByName(joined)


def _likest(sets: DataFrame, items: np.ndarray, number: np.ndarray, term: pa.Array, above: tuple[int, int]) -> DataFrame:
    words = term.unique()
    known = sets.sparkSession.sparkContext.broadcast((items, number, pc.index_in(term, words).to_numpy(), words))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, number, column, words = known.value
        matrix = np.zeros((len(words), items.size), np.int32)
        matrix[column, number] = 1
        size, most, n = np.bincount(number, minlength=items.size), np.zeros(items.size), np.zeros(items.size, np.int64)
        rows = max(1, STEP // max(1, items.size))
        for batch in batches:
            terms = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
            at = pc.index_in(terms.flatten(), words.cast(terms.type.value_type)).fill_null(-1).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
            at = at[at >= 0]
            heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if row.size else row
            ends = np.append(heads[1:], row.size)
            a = 0
            while a < heads.size:  # whole documents, about STEP sums
                b = max(a + 1, int(np.searchsorted(ends, heads[a] + rows, "right")))
                x, y = heads[a], ends[b - 1]
                shared = np.add.reduceat(matrix[at[x:y]], heads[a:b] - x, axis=0, dtype=np.int64)
                either = size + sizes[row[heads[a:b]]][:, None] - shared
                most = np.maximum(most, (shared / either).max(0))
                n += (shared * above[1] > either * above[0]).sum(0)
                a = b
        some = np.flatnonzero(most > 0)
        yield pa.RecordBatch.from_arrays([pa.array(items[some], pa.int64()), pa.array(most[some]), pa.array(n[some])], names=["item_id", "most", "n"])

    return sets.mapInArrow(scan, "item_id long, most double, n long")
