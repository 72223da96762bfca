"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns the training documents into index segments, one row per block of
whole documents: the block's terms (64-bit hashes, sorted), for each term its postings
(ascending word positions, counted through the block), and the block's documents. The
index is cut by documents, so it needs no shuffle, no term's postings meet in one task
however frequent it is, and it can serve any number of benchmarks.

``search`` takes the benchmark's windows (bounded blocks of them are broadcast) against
every segment. A window's terms are ordered by the length of their postings there; the
rarest term's postings, less its offset in the window, are the candidate starts, and
each further term keeps the candidates that its own offset-adjusted postings hold too.
With ``slop`` > 0 a term may lie up to that many words from its place (proximity).
What is left are the occurrences; the words they cover are counted per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, shared_folder, slices, text_buffer, unused, words_of

#: Words are runs of a-z (after lower-casing A-Z), 0-9 and everything beyond ASCII.
SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
#: Most benchmark text that is broadcast at once; more is searched block by block.
QUERY_BYTES = 4 << 20

SEGMENT = "doc_ids array<bigint>, doc_starts array<int>, terms array<bigint>, term_starts array<int>, postings array<int>"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, first word of each row) of a text column."""
    data, offsets = text_buffer(column)
    h, row, _, _ = words_of(data, offsets, byte_values(SEPARATORS, lower=True))
    return h.view(np.int64), np.searchsorted(row, np.arange(len(column) + 1))


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        h, starts = terms_of(part.column("text"))
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.empty(0, np.int64)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        yield pa.RecordBatch.from_arrays(
            [one(part.column("doc_id").to_pylist(), pa.int64()), one(starts.astype(np.int32), pa.int32()), one(ranked[first], pa.int64()),
             one(np.append(first, len(ranked)).astype(np.int32), pa.int32()), one(order.astype(np.int32), pa.int32())],
            names=["doc_ids", "doc_starts", "terms", "term_starts", "postings"])


def build_index(docs: DataFrame) -> DataFrame:
    """Index segments of the documents (columns of SEGMENT); null texts have no words."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_segment, SEGMENT)


class Queries:
    """The distinct windows of some benchmark items: term hashes, and the items of each."""

    def __init__(self, item_ids: list, texts: list, window: int):
        h, starts = terms_of(pa.array(texts, pa.string()))
        found: dict[bytes, set] = {}
        for i, item in enumerate(item_ids):
            words = h[starts[i]:starts[i + 1]]
            for at in range(max(len(words) - window, 0) + 1 if len(words) else 0):
                found.setdefault(words[at:at + window].tobytes(), set()).add(item)
        self.windows = [np.frombuffer(w, dtype=np.int64) for w in found]
        self.items = [sorted(x, key=str) for x in found.values()]
        self.terms, at = np.unique(np.concatenate(self.windows), return_inverse=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.numbers = np.split(at, np.cumsum([len(w) for w in self.windows])[:-1]) if found else []
        #: Windows of one length as a matrix of term numbers, for dropping many at once.
        lengths = np.asarray([len(w) for w in self.windows])
        self.by_length = [(np.flatnonzero(lengths == n), np.stack([self.numbers[i] for i in np.flatnonzero(lengths == n)])) for n in np.unique(lengths)]


def near(candidates: np.ndarray, places: np.ndarray, slop: int) -> np.ndarray:
    """Which candidates (sorted) have a place (sorted) at most ``slop`` away."""
    at = np.searchsorted(places, candidates - slop)
    return places[np.minimum(at, len(places) - 1)] - candidates <= slop if len(places) else np.zeros(len(candidates), bool)


def occurrences(queries: Queries, terms: np.ndarray, term_starts: np.ndarray, postings: np.ndarray, doc_starts: np.ndarray, slop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(window number, starts in the segment) of windows that occur within one document."""
    if not len(terms):
        return
    at = np.minimum(np.searchsorted(terms, queries.terms), len(terms) - 1)
    at = np.where(terms[at] == queries.terms, at, -1)
    sizes = np.where(at >= 0, term_starts[at + 1] - term_starts[at], 0)
    for numbers, matrix in queries.by_length:
        for i in numbers[(sizes[matrix] > 0).all(axis=1)]:
            own = queries.numbers[i]
            rare_first = np.argsort(sizes[own], kind="stable")
            places = lambda j: postings[term_starts[at[own[j]]]:term_starts[at[own[j]] + 1]] - j  # noqa: E731, B023
            starts = places(rare_first[0])
            for j in rare_first[1:]:
                if not len(starts):
                    break
                other = places(j)
                starts = starts[near(starts, np.sort(other), slop)] if len(other) < 1 << 62 else starts
            if len(starts):
                doc = np.searchsorted(doc_starts, starts, side="right") - 1
                starts = starts[(starts >= 0) & (doc >= 0) & (starts + len(own) <= doc_starts[np.minimum(doc + 1, len(doc_starts) - 1)])]
                if len(starts):
                    yield int(i), starts


HITS = "doc_id bigint, n_words bigint, n_hit bigint, hits array<struct<item_id:string,start:int,end:int>>"
_HIT = pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def search(index: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside occurrences), hits.

    ``hits`` lists per item the covered word ranges (ends exclusive, overlapping ranges of
    an item merged). Items without words have no windows; an item of fewer than ``window``
    words is one window; null item ids are kept as the text 'null'. The benchmark is read to the
    driver in blocks of bounded size, each broadcast to all segments; its size doesn't
    grow with the documents.
    """
    spark = index.sparkSession
    blocks: list[Queries] = []
    ids: list[str] = []
    texts: list[str] = []
    held = 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"] or "")
        held += len(texts[-1]) + 16
        if held > QUERY_BYTES:
            blocks.append(Queries(ids, texts, window))
            ids, texts, held = [], [], 0
    blocks.append(Queries(ids, texts, window))
    sent = [spark.sparkContext.broadcast(q) for q in blocks]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].values for n in batch.schema.names}
                doc_starts = row["doc_starts"].to_numpy()
                n_docs = len(doc_starts) - 1
                covered = np.zeros(int(doc_starts[-1]) + 1, dtype=np.int32)
                hits: list[dict[str, list[list[int]]]] = [{} for _ in range(n_docs)]
                terms, term_starts, postings = (row[n].to_numpy() for n in ("terms", "term_starts", "postings"))
                for block in sent:
                    q = block.value
                    for i, starts in occurrences(q, terms, term_starts, postings, doc_starts, slop):
                        n = len(q.windows[i])
                        np.add.at(covered, starts, 1)
                        np.add.at(covered, starts + n, -1)
                        docs = np.searchsorted(doc_starts, starts, side="right") - 1
                        for d, s in zip(docs.tolist(), (starts - doc_starts[docs]).tolist()):
                            for item in q.items[i]:
                                hits[d].setdefault(item, []).append([s, s + n])
                inside = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
                n_hit = inside[doc_starts[1:]] - inside[doc_starts[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"], pa.array(np.diff(doc_starts), pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array([merged(h) for h in hits], pa.list_(_HIT))], names=["doc_id", "n_words", "n_hit", "hits"])

    return index.mapInArrow(scan, HITS)


def merged(hits: dict[str, list[list[int]]]) -> list[dict]:
    out = []
    for item in sorted(hits):
        ranges: list[list[int]] = []
        for s, e in sorted(hits[item]):
            if ranges and s <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], e)
            else:
                ranges.append([s, e])
        out += [{"item_id": item, "start": s, "end": e} for s, e in ranges]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits.

    A document is contaminated if it has hit words and they are at least a twentieth of
    its words. Null texts have no words; null and repeated ids are judged row by row; an
    empty table gives no rows and an empty benchmark no hits; other columns are ignored.
    """
    shared_folder(docs.sparkSession)
    index = build_index(docs).checkpoint()
    found = search(index, benchmark, window, slop)
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h.item_id)))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents (all columns, whatever their names) that aren't contaminated.

    Null and word-less texts have no words, so they stay; rows of one id, null among them,
    go if any of them is contaminated. An empty table gives no rows, an empty benchmark
    drops none.
    """
    bad_id, = unused(docs, "_doc_id")
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias(bad_id)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(bad_id)), "left_anti")
