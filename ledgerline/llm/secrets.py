"""Secret scans with corpus-wide ownership frequency.

One pass finds, per kind, the leftmost non-overlapping matches of fixed patterns (`assign`,
`access`, `hex`) and further candidates: long tokens that look random. Each match's
value is hashed; only the hashes leave the text. For every hash the corpus is asked in how many
distinct repositories (documents, unless a column says otherwise) and by how many distinct
owners (sources) it is used; each is counted once, also where a repository has several owners. A value that
fewer than `shared` owners use is `live`, in however many repositories; one of `shared` owners or more is a
widely copied `example`. The method adds the live candidates to the pattern spans as kind `live`; pattern spans
always stay. Every span carries its repositories, owners and status.

The counts are taken on distinct (hash, repository) and (hash, owner) first, so a value that a third
of all documents holds is spread over tasks until only numbers are left. They come back to the matches by way
of the distinct (hash, block of rows), so such a value is no hot key there either.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; offsets are code
points, the end exclusive; repeated rows are scanned each by itself and, with equal ids, count as one
repository; a null owner is an owner of its own, null repositories are one repository; an empty table gives no
rows. `keep` may name any columns of docs but `spans`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ledgerline.llm.common import stage

KINDS = ("assign", "access", "hex", "live")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a greedy run of 32 or more, as [0-9a-f]+ with shorter runs dropped
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_RUN = re.compile(r"[A-Za-z0-9]{16,}")
_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))
BLOCK_BITS = 14  # rows of one task that share a join key with a hash: 2^14
#: A value that so many owners share is a widely copied example.
EXAMPLE_OWNERS = 5
_MATCH = StructType([StructField(c, LongType() if c == "hash" else IntegerType()) for c in ("kind", "start", "end", "hash")])
SCAN = [StructField("row", LongType()), StructField("found", ArrayType(_MATCH))]


def _random_looking(value: str) -> bool:
    """Digits and letters of both cases, or a run with digits among letters or whose case changes often; not words or paths."""
    n = len(value)
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        runs = _RUN.findall(value)
        changes = lambda r: sum(a.isupper() != b.isupper() for a, b in zip(r, r[1:], strict=False))
        if not any((any(c.isdigit() for c in r) and any(c.isalpha() for c in r)) or changes(r) >= 0.45 * len(r) for r in runs):
            return False
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= 3.5


def matches(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the pattern matches and, as kind 3, of candidates outside of them."""
    out = [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    base = out[:]
    out += [(3, m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text) if _random_looking(m[0]) and not any(m.start() < e and s < m.end() for _, s, e, _ in base)]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        found = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            found.append([{"kind": k, "start": s, "end": e, "hash": int.from_bytes(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)} for k, s, e, v in matches(text)])
        ids = pa.array(range(row, row + len(found)), pa.int64())
        row += len(found)
        columns = [ids, pa.array(found, _FOUND), *(batch.column(i) for i in range(1, batch.num_columns))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "found", *batch.schema.names[1:]])


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", keep: tuple[str, ...] = ("doc_id",), shared: int = 2) -> DataFrame:
    """One row per document: the columns `keep` and `spans` array<struct<kind, start, end, hash, repositories, owners, status>>.

    shared: the owners from which on a value is an example; op8 and the pipeline use EXAMPLE_OWNERS.
    """
    # the kept columns travel as one struct, so that their names meet none of ours
    kept = F.struct(*(F.col(f"`{c}`") for c in keep))
    own = lambda c: F.struct(F.col(f"`{c}`").isNull().alias("none"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("id"))
    asked = docs.select(F.col("text").cast("string").alias("text"), own(repository).alias("repository"), own(owner).alias("owner"), kept.alias("kept"))
    schema = StructType([*SCAN, *list(asked.schema)[1:]])
    scanned = stage(asked.mapInArrow(_scan, schema))
    each = scanned.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("f")).select("row", "repository", "owner", "f.*")
    use = each.groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    status = F.when(F.col("owners") < shared, "live").otherwise("example")
    block = F.shiftright("row", BLOCK_BITS)
    held = each.select("hash", block.alias("block")).distinct().join(use.withColumn("status", status), "hash")
    each = each.withColumn("block", block).join(held, ["hash", "block"])
    each = each.where((F.col("kind") < 3) | (F.col("status") == "live"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct(F.col("start"), F.col("kind").alias("order"), F.col("end"), kind.alias("kind"), "hash", "repositories", "owners", "status")
    spans = each.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = scanned.select("row", "kept").join(spans, "row", "left")
    none = F.expr("filter(array(struct(0 as start, 0 as `order`, 0 as `end`, '' as kind, 0L as hash, 0L as repositories, 0L as owners, '' as status)), x -> false)")
    return out.select("kept.*", F.coalesce("spans", none).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with the (possibly overlapping) spans replaced by a mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
