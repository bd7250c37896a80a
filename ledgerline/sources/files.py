"""Readers and sinks of the engine's file formats: JSON catalogues, fixed-width coordinates, docking logs, CSV, Markdown.

Everything goes through Spark's readers and writers, so that any file system of the cluster works.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session (spark.checkpoint.dir); only on one machine, as in tests, in a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(t: DataFrame) -> DataFrame:
    """t written once and read again: what follows neither repeats its work nor depends on the executors that did it."""
    path = scratch(t.sparkSession, "table")
    t.write.parquet(path)
    return t.sparkSession.read.schema(t.schema).parquet(path)


def read_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A catalogue in JSON, with an explicit schema: a flat list, or an object that nests the list under `records`."""
    flat = spark.read.schema(f"{schema}, records array<struct<{', '.join(f.replace(' ', ': ', 1) for f in schema.split(', '))}>>").json(path)
    columns = [f.split(" ")[0] for f in schema.split(", ")]
    nested = flat.where("records IS NOT NULL").select(F.explode("records").alias("r")).select("r.*")
    return flat.where("records IS NULL").select(*columns).unionByName(nested)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results that JSON documents nest as a list, one row each, with an explicit schema."""
    fields = ", ".join(f.replace(" ", ": ", 1) for f in schema.split(", "))
    return spark.read.schema(f"kind string, results array<struct<{fields}>>").json(path).select(F.explode("results").alias("r")).select("r.*")


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of fixed-width lines (ATOM or HETATM): serial, residue number, x, y, z; lines that do not parse are dropped."""
    line = F.col("value")
    field = lambda a, n, kind: F.trim(F.substring(line, a, n)).try_cast(kind)
    t = spark.read.text(path).where(line.rlike("^(ATOM|HETATM)"))
    t = t.select(field(7, 5, "long").alias("serial"), field(23, 4, "long").alias("residue"), field(31, 8, "double").alias("x"), field(39, 8, "double").alias("y"), field(47, 8, "double").alias("z"))
    return t.na.drop()


_ROW = r"^\s*(\d+)\s+(-?\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s*$"


def read_logs(spark: SparkSession, path: str, log: str) -> DataFrame:
    """Result rows of docking logs (partition column `log`): mode, affinity and bounds; a log without table rows gives
    the values of its loose `Affinity:` lines, with mode 0."""
    t = spark.read.text(path)
    part = lambda i, kind: F.regexp_extract("value", _ROW, i).cast(kind)
    rows = t.where(F.col("value").rlike(_ROW)).select(log, part(1, "long").alias("mode"), part(2, "double").alias("affinity"), part(3, "double").alias("low"), part(4, "double").alias("high"))
    loose = t.join(rows.select(log).distinct(), log, "left_anti").where(F.col("value").rlike(r"Affinity:\s*-?\d"))
    found = F.regexp_extract("value", r"Affinity:\s*(-?\d+(\.\d+)?)", 1).cast("double")
    return rows.unionByName(loose.select(log, F.lit(0).cast("long").alias("mode"), found.alias("affinity"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))


def split_models(text: Column) -> Column:
    """Blocks between MODEL and ENDMDL; the whole text if there is none."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)MODEL[^\n]*\n(.*?)\nENDMDL"), 1)
    return F.when(F.size(blocks) > 0, blocks).otherwise(F.array(text))


def read_training(spark: SparkSession, path: str, numbers: tuple[str, ...]) -> DataFrame:
    """A CSV with a header: the named columns as doubles; rows in which one does not parse are dropped."""
    t = spark.read.option("header", True).csv(path)
    return t.withColumns({c: F.col(c).try_cast("double") for c in numbers}).na.drop(subset=list(numbers))


def parse_references(t: DataFrame, column: str) -> DataFrame:
    """Lines `[N] text` of Markdown: number, title (the first sentence of four words or more, or null), raw text."""
    raw = F.regexp_extract(column, r"^\[(\d+)\]\s*(.*)$", 2)
    chunks = F.filter(F.split(raw, r"\. "), lambda c: F.size(F.split(F.trim(c), " +")) >= 4)
    no = F.regexp_extract(column, r"^\[(\d+)\]", 1).try_cast("long")
    return t.select(no.alias("no"), F.when(F.size(chunks) > 0, F.trim(chunks[0])).alias("title"), raw.alias("raw")).where("no IS NOT NULL")


def resume(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a stage: read if the stage has been written as a whole, otherwise built and written first.

    A mark is written after the rows, so that a stage that broke off is built again.
    """
    try:
        done = spark.read.schema("done boolean").parquet(f"{path}/mark").count() > 0
    except AnalysisException:
        done = False
    if not done:
        build().write.mode("overwrite").parquet(f"{path}/rows")
        spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{path}/mark")
    return spark.read.parquet(f"{path}/rows")
