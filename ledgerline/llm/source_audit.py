"""Divergence of sources by their word frequencies: two counts, the second through minimal perfect hashes.

1. Each language's terms are counted by documents, partly in each task and exactly by a shuffle; those of fewer than `least_docs`
   documents end here.
2. The kept (language, term) keys are dealt to shards by hash, and each shard builds a minimal perfect hash with its keys stored by slot.
3. The shards are broadcast, at most BROADCAST_BYTES at once; a vocabulary beyond that takes more rounds over the documents, so
   the driver and a worker never hold more. A task looks up the distinct terms of each chunk, compares them with the key stored in their slot,
   and increments a dense array of slots for each (language, source) group; arrays that together pass DENSE_BYTES are
   flushed. What leaves a task is a row for each group and slot that it has counted, so no group is hot.
4. Each shard turns its groups' counts into smoothed shares, in integers, and sums their differences for all pairs of a language's
   sources, which are the result's own rows. A shard holds fewer terms the more sources there are.

Shares: 1 + floor(SCALE * (count + 5) / (N + 5 V)), N the group's counts of kept terms, V the language's kept terms. The division goes
by thousands, exact for counts up to 9 * 10^15.

Defined results: null text, lang and source are empty strings, and so are groups of their own; each row is a document, whatever its id;
groups without kept terms count 0 of each; a language without kept terms gives its pairs of sources the value 0; a single source has
no pairs. Ties go to the smaller item by UTF-8. Texts of any length are read whole; an empty table gives no rows; other columns are ignored.
Terms are told apart by a 64-bit hash and compared byte by byte with the stored key; two kept terms of one language with the same hash
are refused with an error (one in a thousand corpora of 10^8 kept terms).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import mix, pieces, stage, text_buffers, text_chunks, word_bounds, word_hashes
from ledgerline.llm.perfect_hash import PerfectHash

SCALE = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50
#: Terms and (source, term) cells of a shard; bytes of shards that are broadcast at once; bytes of a task's slots; terms that a task holds in the first count.
SHARD_TERMS, SHARD_CELLS, BROADCAST_BYTES, DENSE_BYTES, HELD_TERMS = 4096, 1 << 22, 64 << 20, 128 << 20, 1 << 18

#: Bytes that part terms: ASCII other than letters.
_GAPS = np.ones(256, bool)
_GAPS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _terms(col: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: first and end row, bytes, terms' starts and ends, their rows, an order that sorts their hashes (rows ascending), the sorted hashes."""
    for a, b, data, offs in text_chunks(col):
        starts, ends, first = word_bounds(data, offs, _GAPS)
        h = word_hashes(data, starts, ends, lower=True)
        order = np.argsort(h, kind="stable")
        yield a, b, data.tobytes(), starts, ends, np.repeat(np.arange(b - a), np.diff(first)), order, h[order]


def _heads(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.ones(sorted_by[0].size, bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return new


def _hash_of(said: str | bytes) -> np.uint64:
    """word_hashes() of one string."""
    raw = np.frombuffer(said.encode() if isinstance(said, str) else said, np.uint8)
    return word_hashes(raw, np.zeros(1, np.int64), np.array([raw.size]))[0] if raw.size else np.uint64(0)


def _keys(lang: str, h: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(np.array([_hash_of(lang)]) + np.uint64(1)))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def document_frequencies(rows: DataFrame, held_terms: int) -> DataFrame:
    """rows(lang, text), no nulls → lang, term, docs: the documents of the language that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, bytes]] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["lang", "term", "docs"])
            held.clear()
            return made

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for a, b, raw, starts, ends, row, order, h in _terms(batch.column("text")):
                once = np.flatnonzero(_heads(h, row[order]))
                order, h = order[once], h[once]
                spoken = code[a:b][row[order]]
                for c in np.unique(spoken):
                    own = np.flatnonzero(spoken == c)
                    head = np.flatnonzero(_heads(h[own]))
                    times = np.diff(np.append(head, own.size))
                    for i, n in zip(order[own[head]].tolist(), times.tolist(), strict=True):
                        held[names[c], raw[starts[i] : ends[i]].lower()] += n
                if len(held) > held_terms:
                    yield out()
        yield out()

    return rows.select("lang", "text").mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def perfect_shards(kept: DataFrame, shards: int) -> DataFrame:
    """kept(lang, term) → shard, bits, widths, langs, terms: a minimal perfect hash for each shard, its keys by slot."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column("term"))
            h, key = word_hashes(data, offs[:-1], offs[1:]), np.zeros(batch.num_rows, np.uint64)
            langs = batch.column("lang").dictionary_encode()
            for c, name in enumerate(langs.dictionary.to_pylist()):
                own = langs.indices.to_numpy() == c
                key[own] = _keys(name, h[own])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), pa.array(key.view(np.int64)), pa.array(_shard_of(key, shards))], names=["lang", "term", "key", "shard"])

    def build(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        made = PerfectHash.build(keys)
        table = table.take(pa.array(np.argsort(made.slots(keys))))
        bits, widths = made.dump()
        return pa.table({"shard": table.column("shard")[:1], "bits": [bits], "widths": [widths], "langs": [table.column("lang").to_pylist()], "terms": [table.column("term").to_pylist()]})

    dealt = kept.select("lang", "term").mapInArrow(deal, "lang string, term string, key long, shard long")
    return dealt.groupBy("shard").applyInArrow(build, "shard long, bits binary, widths binary, langs array<string>, terms array<string>")


def recount(rows: DataFrame, index: Iterable, shards: int, dense_bytes: int) -> DataFrame:
    """rows(lang, source, text), no nulls → lang, source, shard, slot, n: occurrences of the terms of these shards, a row for each task, group and slot."""
    sent = rows.sparkSession.sparkContext.broadcast([(r.shard, r.bits, r.widths, r.langs, r.terms) for r in index])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, base = {}, 0
        for shard, bits, widths, langs, terms in sent.value:
            parts[shard] = (base, PerfectHash.load(bits, widths), langs, [t.encode() for t in terms])
            base += len(terms)
        begins = np.array([p[0] for p in parts.values()], np.int64)
        numbers = np.array(list(parts), np.int64)
        dense: dict[tuple[str, str], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), slots in dense.items():
                at = np.flatnonzero(slots)
                part = np.searchsorted(begins, at, "right") - 1
                same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(at.size, np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(numbers[part]), pa.array((at - begins[part]).astype(np.int32)), pa.array(slots[at])], names=["lang", "source", "shard", "slot", "n"])
            dense.clear()

        def look_up(lang: str, h: np.ndarray, said: list[bytes]) -> np.ndarray:
            keys = _keys(lang, h)
            shard, found = _shard_of(keys, shards), np.full(h.size, -1, np.int64)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if own.size and (part := parts.get(int(shard[own[0]]))):
                    begin, made, langs, terms = part
                    for i, s in zip(own.tolist(), made.slots(keys[own]).tolist(), strict=True):
                        if s >= 0 and terms[s] == said[i] and langs[s] == lang:
                            found[i] = begin + s
            return found

        for batch in batches:
            langs, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            names, origins = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
            spoken, origin = langs.indices.to_numpy().astype(np.int64), sources.indices.to_numpy().astype(np.int64)
            for a, b, raw, starts, ends, row, order, h in _terms(batch.column("text")):
                if not order.size:
                    continue
                head = _heads(h)
                which, group = np.cumsum(head) - 1, (spoken * len(origins) + origin)[a:b][row[order]]
                firsts = order[head]
                said = [raw[s:e].lower() for s, e in zip(starts[firsts].tolist(), ends[firsts].tolist(), strict=True)]
                by_group = np.argsort(group, kind="stable")
                cuts = np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1)
                slots: dict[int, np.ndarray] = {}
                for own in cuts:
                    c, o = divmod(int(group[own[0]]), len(origins))
                    if c not in slots:
                        here = np.unique(which[spoken[a:b][row[order]] == c])
                        slots[c] = np.full(len(said), -1, np.int64)
                        slots[c][here] = look_up(names[c], h[head][here], [said[i] for i in here.tolist()])
                    to = slots[c][which[own]]
                    to = to[to >= 0]
                    if to.size:
                        own_slots = dense.setdefault((names[c], origins[o]), np.zeros(base, np.int64))
                        places, times = np.unique(to, return_counts=True)
                        own_slots[places] += times
                if len(dense) * base * 8 > dense_bytes:
                    yield from out()
        yield from out()

    return rows.select("lang", "source", "text").mapInArrow(count, "lang string, source string, shard long, slot int, n long")


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), in integers."""
    whole = np.maximum(total + SMOOTH * terms, 1)
    done, rest = np.divmod(count + SMOOTH, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        done = done * 1000 + more
    return 1 + done


def audit_sources(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """docs(text, lang, source) → lang, source, part ('pair' or 'term'), item, value long, rank int (from 1 by group and part)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    kept = stage(document_frequencies(rows, HELD_TERMS).where(F.col("docs") >= least_docs).select("lang", "term"))
    groups = stage(rows.select("lang", "source").distinct())
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    shards = pieces(kept.count(), max(16, min(SHARD_TERMS, SHARD_CELLS // most)))
    index = stage(perfect_shards(kept, shards))
    held = index.agg(F.sum(F.length("bits") + F.length("widths") + F.size("terms") * 80 + F.octet_length(F.array_join("terms", "")) + F.octet_length(F.array_join("langs", "")))).first()[0]
    rounds = pieces(held, BROADCAST_BYTES)
    told = None
    for r in range(rounds):
        # shards are even in size, so a round's share of them is its share of the bytes
        some = index.where((F.col("shard") * rounds / F.lit(shards)).cast("int") == r).collect()
        part = recount(rows, some, shards, DENSE_BYTES)
        told = part if told is None else told.union(part)
    counts = stage(told.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")))

    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = groups.join(total, ["lang", "source"], "left").na.fill(0, ["total"])
    spoken = by_lang.groupBy("lang").agg(F.sum("total").alias("spoken")).join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").na.fill(0, ["terms"])
    facts = by_lang.join(spoken, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    words = index.select("shard", F.posexplode(F.arrays_zip("langs", "terms"))).select("shard", F.col("pos").alias("slot"), F.col("col.langs").alias("lang"), F.col("col.terms").alias("term"))
    both = counts.unionByName(facts, allowMissingColumns=True).unionByName(words, allowMissingColumns=True).select("shard", "lang", "source", "slot", "n", "term", "total", "spoken", "terms")

    def compare(table: pa.Table) -> pa.Table:
        made: list[tuple[str, str, str, str, int]] = []
        facts, words = table.filter(pc.is_valid(table.column("total"))), table.filter(pc.is_valid(table.column("term")))
        counted = table.filter(pc.is_valid(table.column("n")))
        for lang in pc.unique(facts.column("lang")).to_pylist():
            own, said, seen = (t.filter(pc.equal(t.column("lang"), lang)) for t in (facts, words, counted))
            sources, said = own.column("source").to_pylist(), said.sort_by("slot")
            n = np.zeros((len(sources), said.num_rows), np.int64)
            place = {s: i for i, s in enumerate(sources)}
            row = np.array([place[s] for s in seen.column("source").to_pylist()], np.int64)
            n[row, np.searchsorted(said.column("slot").to_numpy(), seen.column("slot").to_numpy())] = seen.column("n").to_numpy()
            vocabulary = own.column("terms")[0].as_py()
            p = shares(n, own.column("total").to_numpy()[:, None], vocabulary)
            q = shares(n.sum(0), np.int64(own.column("spoken")[0].as_py()), vocabulary)
            items = said.column("term").to_pylist()
            raw = [t.encode() for t in items]
            for i, source in enumerate(sources):
                apart = np.abs(p - p[i]).sum(1).tolist()
                made += [(lang, source, "pair", other, v) for j, (other, v) in enumerate(zip(sources, apart, strict=True)) if j != i]
                over = np.flatnonzero((n[i] > 0) & (p[i] > q))
                value = (p[i] - q)[over]
                if over.size > TOP_TERMS:
                    near = value >= np.partition(value, -TOP_TERMS)[-TOP_TERMS]
                    over, value = over[near], value[near]
                best = sorted(zip((-value).tolist(), [raw[t] for t in over.tolist()], over.tolist(), strict=True))[:TOP_TERMS]
                made += [(lang, source, "term", items[t], -v) for v, _, t in best]
        return pa.table([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(),) * 4 + (pa.int64(),))], names=["lang", "source", "part", "item", "value"])

    found = both.groupBy("shard").applyInArrow(compare, "lang string, source string, part string, item string, value long")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
