"""Source divergence audit: how the words of a language's sources differ, by single-pass in-memory indexing.

* Each task indexes its documents in one pass in memory (``Block``: occurrences by (lang,
  source) and term, documents by lang and term). Once BLOCK entries are held the block is
  spilled: its terms are sorted and cut by hash shard into runs, which travel as packed
  chunks of at most CHUNK terms.
* A shard's chunks come sorted by their first term. They are merged with a heap that
  takes a chunk in only when the merge has reached its first term, so no more than one
  chunk of each run is open. Terms in fewer documents of the language than asked for end
  here; the others are stored as frequencies (lang, term, source, n).
* With the totals of the groups known, a group's value against another is the sum for
  groups that have no term at all, corrected by one group's terms (by how many of them
  occur how often) and by the terms that both have. The latter are streamed term by term,
  and a task keeps only sums by pair of groups.

All arithmetic is on whole numbers. Smoothed share: p = 1 + floor(10^9 (n + 1) / (N + V));
divergence of a term: floor((p - q)^2 / q).
"""

from __future__ import annotations

import heapq
import itertools
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_index
from .common import shards_for, slices, stored

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Entries (term of a group or language) that a block holds before it is spilled.
BLOCK = 1 << 20
#: Bytes of a text that are split at a time, up to the end of a term.
PIECE = 1 << 20
#: Terms of a chunk.
CHUNK = 4096
#: Pairs of groups handled together, and sums by pair held in a task.
PAIRS = 1 << 20

RUNS = "lang string, shard int, first binary, terms binary, docs binary, has binary, sources array<string>, source binary, n binary"


def pieces(text: bytes) -> Iterator[bytes]:
    """The text with A-Z lower-cased, cut between terms."""
    at = 0
    while len(text) - at > PIECE and (cut := BREAK.search(text, at + PIECE)):
        yield text[at:cut.start()].lower()
        at = cut.end()
    yield text[at:].lower()


class Block:
    """Postings of the documents read so far: term counts by (lang, source), document counts by lang."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[str, Counter] = {}
        self.held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, docs = self.counts.setdefault((lang, source), Counter()), self.docs.setdefault(lang, Counter())
        before = len(counts) + len(docs)
        seen: set[bytes] = set()
        for piece in pieces(text):
            terms = TERM.findall(piece)
            counts.update(terms)
            seen.update(terms)
        docs.update(seen)
        self.held += len(counts) + len(docs) - before

    def runs(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The block as term-sorted runs by language and shard, in chunks."""
        for lang, docs in self.docs.items():
            terms = sorted(docs, key=lambda t: (zlib.crc32(t) % shards, t))
            place = {t: i for i, t in enumerate(terms)}
            sources = sorted(s for other, s in self.counts if other == lang)
            own = [self.counts[lang, s] for s in sources]
            at = np.fromiter((place[t] for c in own for t in c), np.int64)
            n = np.fromiter((x for c in own for x in c.values()), np.int64, len(at))
            source = np.repeat(np.arange(len(own), dtype=np.int32), [len(c) for c in own])
            order = np.argsort(at, kind="stable")
            at, n, source = at[order], n[order], source[order]
            df = np.fromiter((docs[t] for t in terms), np.int64, len(terms))
            shard = np.fromiter((zlib.crc32(t) % shards for t in terms), np.int64, len(terms))
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            cuts = np.unique(np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(cuts, np.append(cuts[1:], len(terms)))])) if len(terms) else cuts
            ends = np.append(cuts[1:], len(terms))
            low, high = np.searchsorted(at, cuts), np.searchsorted(at, ends)
            has = np.bincount(at, minlength=len(terms)).astype("<i4")
            rows = [(lang, int(shard[a]), terms[a], b"\0".join(terms[a:b]), df[a:b].tobytes(), has[a:b].tobytes(), sources, source[x:y].tobytes(), n[x:y].tobytes())
                    for a, b, x, y in zip(cuts.tolist(), ends.tolist(), low.tolist(), high.tolist())]
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows[i:i + 64]], schema=SCHEMA)


NAMES = [c.split()[0] for c in RUNS.split(", ")]
SCHEMA = pa.schema([("lang", pa.string()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("first", "terms", "docs", "has")), ("sources", pa.list_(pa.string())), ("source", pa.binary()), ("n", pa.binary())])


def term_runs(rows: DataFrame, shards: int) -> DataFrame:
    """Term-sorted runs of all documents (lang, source, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for part in slices(batches):
            langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, part.column("text").cast(pa.binary())):
                block.add(lang, source, text.as_py())
                if block.held >= BLOCK:
                    yield from block.runs(shards)
                    block = Block()
        yield from block.runs(shards)

    return rows.mapInArrow(read, RUNS)


class Cursor:
    """An open chunk: its terms in order, each with document count and counts by source."""

    def __init__(self, row: dict):
        self.terms = row["terms"].split(b"\0")
        self.docs = np.frombuffer(row["docs"], np.int64).tolist()
        self.ends = np.cumsum(np.frombuffer(row["has"], "<i4")).tolist()
        names = row["sources"]
        self.sources = [names[i] for i in np.frombuffer(row["source"], np.int32).tolist()]
        self.n = np.frombuffer(row["n"], np.int64).tolist()

    def add(self, i: int, counts: dict[str, int]) -> int:
        """Adds the i-th term's counts, returns its document count."""
        for k in range(self.ends[i - 1] if i else 0, self.ends[i]):
            counts[self.sources[k]] = counts.get(self.sources[k], 0) + self.n[k]
        return self.docs[i]


def in_order(chunks: Iterator[dict]) -> Iterator[tuple[bytes, Cursor, int]]:
    """(term, chunk, place in it) of all chunks in term order; chunks come in order of their first terms."""
    heap: list = []

    def taken(before: bytes | None) -> Iterator[tuple[bytes, Cursor, int]]:
        while heap and (before is None or heap[0][0] < before):
            term, number, i, cursor = heap[0]
            if i + 1 < len(cursor.terms):
                heapq.heapreplace(heap, (cursor.terms[i + 1], number, i + 1, cursor))
            else:
                heapq.heappop(heap)
            yield term, cursor, i

    for number, row in enumerate(chunks):
        yield from taken(row["first"])
        cursor = Cursor(row)
        heapq.heappush(heap, (cursor.terms[0], number, 0, cursor))
    yield from taken(None)


def merged(chunks: Iterator[dict], least: int) -> Iterator[tuple[bytes, dict[str, int]]]:
    """(term, counts by source) in order, of the terms in at least ``least`` documents."""
    for term, found in itertools.groupby(in_order(chunks), key=operator.itemgetter(0)):
        counts: dict[str, int] = {}
        if sum(cursor.add(i, counts) for _, cursor, i in found) >= least:
            yield term, counts


FREQUENCIES = "lang string, term string, source string, n bigint, n_lang bigint, lead int"


def frequencies(runs: DataFrame, least: int) -> DataFrame:
    """The kept terms' counts by source, and in the whole language; ``lead`` is 1 in one row of each (lang, term)."""
    columns = [(name.split()[0], kind) for name, kind in zip(FREQUENCIES.split(", "), (pa.string(),) * 3 + (pa.int64(),) * 2 + (pa.int32(),))]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        out: list[list] = [[] for _ in columns]
        for (_, lang), chunks in itertools.groupby(rows, key=lambda r: (r["shard"], r["lang"])):
            for term, counts in merged(chunks, least):
                word, total = term.decode(), sum(counts.values())
                for lead, (source, n) in enumerate(counts.items()):
                    for values, value in zip(out, (lang, word, source, n, total, int(lead == 0))):
                        values.append(value)
                if len(out[0]) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, columns)], names=[c for c, _ in columns])
                    out = [[] for _ in columns]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, columns)], names=[c for c, _ in columns])

    return runs.repartition(shards_for(runs), "shard").sortWithinPartitions("shard", "lang", "first").mapInArrow(merge, FREQUENCIES)


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)); null where no terms are kept."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) DIV CAST(nullif({total} + {terms}, 0) AS DECIMAL(20, 0))")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV {q}")


def shared_corrections(entries: DataFrame) -> DataFrame:
    """(a, b, v): what the terms that both groups have add to the sum of a against b over each one's own corrections."""

    def of_terms(start: np.ndarray, size: np.ndarray, gid: np.ndarray, p: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums by pair over whole terms: runs of ``size`` rows from ``start``."""
        member = np.repeat(np.arange(len(start)), size)
        left = np.arange(len(member)) - np.repeat(np.cumsum(size) - size, size) + start[member]
        sums = []
        # a term's rows against all of the term's: as many left rows at a time as give PAIRS pairs
        pairs = np.cumsum(size[member])
        at = 0
        while at < len(left):
            end = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, side="right")))
            wide = size[member[at:end]]
            i = np.repeat(left[at:end], wide)
            j = np.arange(len(i)) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(start[member[at:end]], wide)
            i, j = i[i != j], j[i != j]
            f = lambda x, y: (x - y) ** 2 // y
            v = f(p[i], p[j]) - f(p[i], base[j]) - f(base[i], p[j]) + f(base[i], base[j])
            sums.append(summed(gid[i], gid[j], v))
            at = end
        return tuple(np.concatenate(x) for x in zip(*sums))

    def summed(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        a, b, v = a[order], b[order], v[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[:len(a)]
        return a[first], b[first], np.add.reduceat(v, first) if len(first) else v

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((5, 0), np.int64)
        held: list = []

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in summed(*(np.concatenate(x) for x in zip(*held)))], names=["a", "b", "v"])

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest = np.concatenate([rest, [c.to_numpy(zero_copy_only=False) for c in batch.columns]], axis=1)
            h, k = rest[0], rest[1]
            start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1]))))[:len(h)]
            size = np.diff(start, append=len(h))
            done = len(start) - (batch is not None)  # the last term may go on in the next batch
            if done > 0:
                more = size[:done] > 1
                if more.any():
                    held.append(of_terms(start[:done][more], size[:done][more], *rest[2:]))
                    if sum(len(x[0]) for x in held) > PAIRS:
                        held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                        if len(held[0][0]) > PAIRS // 2:
                            yield sent()
                            held = []
                rest = rest[:, start[done]:] if done < len(start) else rest[:, :0]
        if held:
            yield sent()

    keyed = entries.select(F.xxhash64("lang", "term").alias("h"), F.xxhash64(F.lit(1), "lang", "term").alias("k"), "gid", "p", "base")  # 128 bits stand for a term
    return keyed.repartition("h").sortWithinPartitions("h", "k").mapInArrow(stream, "a bigint, b bigint, v bigint").groupBy("a", "b").agg(F.sum("v").alias("v"))


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: the audit of every (lang, source) of ``docs``.

    Null text, lang and source count as ''. Terms are runs of letters and of non-ASCII
    characters, A-Z lower-cased; a language keeps those in at least ``min_docs`` of its
    rows. With V kept terms and N occurrences of them in a group, a group's share of a term
    is p = 1 + floor(10^9 (n + 1) / (N + V)). Part ``pair`` has each other source of the language
    with the summed divergence over all kept terms (0 without any), all ranks; part ``term``
    the kept terms that the group has and whose p is above the language's, up to rank
    ``top``. Ranks go by value descending, then item ascending (UTF-8). Every row counts
    as a document, repeated ones too; no rows give no rows; a group without terms has pair
    rows only; other columns are ignored. The pair rows are as many as the square of a
    language's sources.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    counts = stored(frequencies(term_runs(rows, 2 * shards_for(docs)), min_docs), "term-frequencies")

    known = counts.groupBy("lang").agg(F.sum("lead").alias("terms"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(known, "lang", "left").na.fill(0)
    groups = stored(global_index(named.withColumn("base", share("0L", "total", "terms")), ["lang", "source"], "gid"), "source-groups")

    entries = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "gid", "base", "n", share("n", "total", "terms").alias("p"), share("n_lang", "lang_total", "terms").alias("q"))
    by_value = lambda key, item: Window.partitionBy(key).orderBy(F.desc("value"), F.asc(item))
    ranked = (entries.where("p > q").select("lang", "source", "gid", F.col("term").alias("item"), apart("p", "q").alias("value"))
                     .withColumn("rank", F.row_number().over(by_value("gid", "item"))).where(F.col("rank") <= top))

    other = groups.select("lang", F.col("gid").alias("b"), F.col("base").alias("base_b"), F.col("source").alias("item"))
    both = groups.select("lang", F.col("gid").alias("a"), "base", "terms").join(other, "lang").where("a <> b")
    plain = both.select("a", "b", F.coalesce(F.col("terms") * apart("base", "base_b"), F.lit(0)).alias("v"))
    alike = entries.groupBy("lang", "gid", "base", "p").agg(F.count(F.lit(1)).alias("c"))  # terms of a group that occur as often
    one = alike.join(other.drop("item"), "lang").where("gid <> b").select(F.explode(F.array(
        F.struct(F.col("gid").alias("a"), "b", (F.col("c") * (apart("p", "base_b") - apart("base", "base_b"))).alias("v")),
        F.struct(F.col("b").alias("a"), F.col("gid").alias("b"), (F.col("c") * (apart("base_b", "p") - apart("base_b", "base"))).alias("v")))).alias("x")).select("x.*")
    sums = plain.unionByName(one).unionByName(shared_corrections(entries)).groupBy("a", "b").agg(F.sum("v").alias("value"))
    pairs = (groups.select("lang", "source", F.col("gid").alias("a")).join(sums, "a").join(other.select("b", "item"), "b")
                   .withColumn("rank", F.row_number().over(by_value("a", "item"))))
    result = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return result(pairs, "pair").unionByName(result(ranked, "term"))
