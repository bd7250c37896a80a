"""URL filter: host/path rules first, a logistic regression on hashed character n-grams for the rest.

The model sees n-grams (3 to 5 bytes) of `host` and of `path`, hashed into 2^12 slots, each
side marked so that the same letters in host and path are different features. It is fitted
with pyspark.ml on a small labelled URL table (`url_labels`, independent of the rules; any table of url and
label will do). Scoring is one pass without a shuffle: the weights (2^12 doubles, a fixed size) travel with the task.

Defined results: a null url, or one without `://`, has an empty host and path; no rule fits
it and the model judges it by its intercept. Repeated rows are judged alike. Urls of any
length are scored whole. With labels of one class only (or none) the model gives that class
(or `allow`). An empty table gives no rows. Other columns pass through unchanged; one that has an output's name
(host, path, rule, block_score, verdict) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import gram_hashes, lower_ascii, mix, text_chunks
from ledgerline.llm.url_labels import url_labels

SLOTS = 1 << 12
GRAMS = (3, 4, 5)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without `://`."""
    at = F.instr(url, "://")
    after = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def parse_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with `host` and `path`."""
    host, path = host_path(F.col(f"`{url}`").cast("string"))
    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path")], host.alias("host"), path.alias("path"))


def rule_column(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules (host, path, verdict) that fits, both null without one."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tried first
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _slots(col: pa.Array, side: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each n-gram counted from the first, slot) of chunks of a string column."""
    for a, b, data, offs in text_chunks(col):
        n = b - a
        # a mark before and after each text, so that starts and ends are features too
        size = np.diff(offs) + 2
        begin = np.concatenate([[0], np.cumsum(size)])
        marked = np.full(begin[-1], 1, np.uint64)
        row = np.repeat(np.arange(n), size)
        inner = np.ones(begin[-1], bool)
        inner[begin[:-1]] = inner[begin[1:] - 1] = False
        marked[inner] = data.astype(np.uint64) + np.uint64(2)
        rows, slots = [], []
        for k in GRAMS:
            h = gram_hashes(marked, k)
            whole = row[: h.size] == row[k - 1 : k - 1 + h.size]
            rows.append(row[: h.size][whole])
            slots.append((mix(h[whole] + np.uint64(131 * side + k)) % np.uint64(SLOTS)).astype(np.int64))
        yield a, b, np.concatenate(rows), np.concatenate(slots)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.zeros((batch.num_rows, SLOTS))
        for side, name in enumerate(("host", "path")):
            for a, _, row, slot in _slots(batch.column(name), side):
                np.add.at(x, (a + row, slot), 1.0)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x /= np.where(norm > 0, norm, 1)
        yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])


def train_url_model(labelled: DataFrame, max_rows: int = 2048, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept from labelled(url, label 0/1); of a larger table the max_rows with the lowest url hash are used."""
    known = labelled.where(F.col("label").isin(0, 1) & F.col("url").isNotNull()).select("url", F.col("label").cast("double").alias("label")).distinct()
    known = known.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    # small and bounded: one pass through the driver, so that the fit's passes do not sort the labelled table again
    known = known.sparkSession.createDataFrame([tuple(r) for r in known.collect()], known.schema)
    table = parse_urls(known).select("host", "path", "label").coalesce(1).mapInArrow(_features, "x array<double>, label double")
    classes = {r["label"] for r in known.select("label").distinct().collect()}
    if len(classes) < 2:
        return np.zeros(SLOTS), (30.0 if classes == {1.0} else -30.0)
    table = table.select(array_to_vector("x").alias("features"), "label").cache()
    model = LogisticRegression(regParam=reg, maxIter=20, standardization=False).fit(table)
    table.unpersist()
    return model.coefficients.toArray(), float(model.intercept)


def score_urls(parsed: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """parsed(host, path, …) with `block_score`, the model's probability of label 1."""
    weights, intercept = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dot, square = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for side, name in enumerate(("host", "path")):
                for a, b, row, slot in _slots(batch.column(name), side):
                    dot[a:b] += np.bincount(row, weights[slot], b - a)
                    _, count = np.unique(row * SLOTS + slot, return_counts=True)
                    cell = np.unique(row * SLOTS + slot) // SLOTS
                    square[a:b] += np.bincount(cell, count.astype(float) ** 2, b - a)
            z = intercept + dot / np.sqrt(np.where(square > 0, square, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=[*batch.schema.names, "block_score"])

    parsed = parsed.drop("block_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema) + ", block_score double"
    return parsed.mapInArrow(score, schema)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URL table (url, label) of `url_labels`."""
    return spark.createDataFrame(url_labels(), "url string, label int")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, block_score and verdict (`allow` or `block`: the longest rule's, else the model's)."""
    parsed = parse_urls(pages.drop("rule", "verdict", "block_score"))
    rule, verdict = rule_column(rules)
    by_model = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return score_urls(parsed, model).select("*", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"))
