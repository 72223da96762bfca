"""Document fingerprints from prefix polynomial hashes.

The code points c of a text are a polynomial: G[i] is the sum of (c_j + 1) B^j over j < i
modulo the prime 2^61 - 1. From these prefix arrays the hash of any span is
(G[i + n] - G[i]) B^-i, whatever its length and place, so two spans are compared in
constant time, and the longest common extension of two places is found by binary search
over span lengths. Arrays are made for many texts at once; a text takes 8 bytes a code
point for its array and 4 for its code points while it is hashed.

A fingerprint is "length-hash-sketch": code points and hash of the whole text, and for
each of ``BINS`` ranges of span hashes 16 bits of the least one among all spans of
``SPAN`` code points (a shorter text is one span; 0000 where a range has none). Equal
texts have equal fingerprints. The likeness of two fingerprints is 1 if they are equal,
else the share of ranges that agree among those that either has: an unbiased estimate of
the shared part of both span sets, with a standard deviation of at most 0.05.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shards_for, slices

#: Code points of a span in the sketch.
SPAN = 12
#: Ranges of span hashes in the sketch.
BINS = 128
#: Code points hashed together, unless one text is longer.
GROUP = 1 << 20
#: Parts of the ids' order for each shuffle partition.
PARTS = 4

_P = np.uint64((1 << 61) - 1)
_BASE = 0x16A09E667F3BCC9
_U = np.uint64


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1, for any 64-bit x."""
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for reduced a and b, by halves of 31 bits."""
    low = _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U(31), a & low, b >> _U(31), b & low
    middle = a1 * b0 + a0 * b1
    ends = a0 * b0
    return reduced(((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31)) + (ends & _P) + (ends >> _U(61)))


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b modulo 2^61 - 1."""
    return np.where(a >= b, a - b, a + _P - b)


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    n, step = 1, base
    while n < size:
        out[n:2 * n] = times(out[:min(n, size - n)], np.full(1, step, np.uint64))
        step = step * step % int(_P)
        n *= 2
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1)."""
    return _powers(base, max(2 * GROUP + 2, 1 << (n - 1).bit_length()))[:n]


class Prefixes:
    """Prefix hashes of texts laid end to end; ``start`` and ``size`` say where each lies."""

    BLOCK = 1 << 17

    def __init__(self, texts: list[str]):
        self.size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(codes)
        power, self.back = powers(_BASE, n + 1), powers(pow(_BASE, -1, int(_P)), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        for a in range(0, n, self.BLOCK):
            b = min(a + self.BLOCK, n)
            terms = times(codes[a:b].astype(np.uint64) + _U(1), power[a:b])
            high, low = np.cumsum(terms >> _U(31)), np.cumsum(terms & _U((1 << 31) - 1))
            total = (high >> _U(30)) + ((high & _U((1 << 30) - 1)) << _U(31)) + low
            self.sums[a + 1:b + 1] = reduced(reduced(total) + self.sums[a])

    def span(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of the spans of n code points from ``at``."""
        return times(less(self.sums[at + n], self.sums[at]), self.back[at])

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the spans of n code points at i and at j are the same."""
        return self.span(i, n) == self.span(j, n)

    def extension(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the longest span, up to ``limit``, that is the same from i as from j."""
        low, high = np.zeros_like(limit), limit.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(i, j, np.where(open_, middle, 0))
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def sketches(self, k: int = SPAN) -> np.ndarray:
        """Per text, 16 bits of the least span hash in each range, 0 where there is none."""
        none = _U((1 << 64) - 1)
        least = np.full(len(self.size) * BINS, none)

        def put(text: np.ndarray, hashes: np.ndarray) -> None:
            spread = mix(hashes)
            slot = text * BINS + (spread >> _U(57)).astype(np.int64)
            np.minimum.at(least, slot, spread & _U((1 << 57) - 1))

        total = int(self.size.sum())
        for a in range(0, total - k + 1, self.BLOCK):
            at = np.arange(a, min(a + self.BLOCK, total - k + 1))
            text = np.searchsorted(self.start, at, side="right") - 1
            whole = at + k <= self.start[text] + self.size[text]
            put(text[whole], self.span(at[whole], k))
        short = np.flatnonzero((self.size > 0) & (self.size < k))
        put(short, self.span(self.start[short], self.size[short]))
        tags = (mix(least) % _U(65535)).astype(np.uint16) + np.uint16(1)
        return np.where(least == none, np.uint16(0), tags).reshape(-1, BINS)

    def fingerprints(self, sketches: np.ndarray) -> list[str]:
        whole = self.span(self.start, self.size)
        return [f"{n:x}-{h:016x}-{s.astype('>u2').tobytes().hex()}" for n, h, s in zip(self.size.tolist(), whole.tolist(), sketches)]


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1; 1 if they are equal."""
    if a == b:
        return 1.0
    s, t = (np.frombuffer(bytes.fromhex(x.rpartition("-")[2]), ">u2") for x in (a, b))
    some = (s > 0) | (t > 0)
    return float((s == t)[some].mean()) if some.any() else 0.0


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about GROUP bytes of text."""
    for part in slices(batches):
        at, sizes = 0, np.asarray(pa.compute.binary_length(part.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        sums = np.cumsum(sizes)
        while at < part.num_rows:
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + GROUP, side="right")))
            yield part.slice(at, end - at)
            at = end


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, one row per input row; null texts count as empty, other columns are ignored."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches):
            made = Prefixes([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made.size, pa.int64()), pa.array(made.fingerprints(made.sketches()), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id bigint, n_chars bigint, fingerprint string")


RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, common_edited bigint, common_next bigint")


def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results of all but the last of consecutive documents: each is held against the next."""
    n = len(texts) - 1
    edited = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for t, u in zip(texts, texts[1:])]
    made = Prefixes(texts + edited)
    prints = made.fingerprints(made.sketches())
    own, other = made.start[:n], made.start[1:n + 1]
    size = made.size[:n]
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:n], pa.int64()), pa.array(size, pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
        pa.array(prints[:n]), pa.array(prints[n + 1:]),
        pa.array([likeness(a, b) for a, b in zip(prints[:n], prints[n + 1:])], pa.float64()), pa.array([likeness(a, b) for a, b in zip(prints[:n], prints[1:n + 1])], pa.float64()),
        pa.array(made.extension(own, made.start[n + 1:], np.minimum(size, made.size[n + 1:])), pa.int64()), pa.array(made.extension(own, other, np.minimum(size, made.size[1:n + 1])), pa.int64()),
    ], names=[c.split()[0] for c in RESULT.split(", ")])


def order_parts(ids: DataFrame, parts: int) -> tuple[list[int], list[tuple[int, int | None, int]]]:
    """(borders, followers) of descending ids (a column ``doc_id``) cut into about ``parts`` runs.

    A part holds the ids up to its border; null ids come last, in the part behind all
    borders. Followers are (part, first id, part before): the first document of each part
    with rows is also needed by the part before it, the first part's by the last. As many
    numbers as parts reach the driver.
    """
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10000, 10 * parts))).first()[0] if parts > 1 else None
    borders = sorted({-c for c in cuts or []})  # ascending in the negative id: descending ids
    rows = ids.select(part_of(borders)("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("first")).orderBy("part").collect()
    return borders, [(r.part, r.first, rows[i - 1].part) for i, r in enumerate(rows)]


def part_of(borders: list[int]):
    """Column function: the part of an id among ascending borders of negative ids; nulls go behind all."""

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(borders) + 1, np.int32)
        out[known] = np.searchsorted(np.asarray(borders, np.int64), -ids[known].to_numpy().astype(np.int64), side="left")
        return pd.Series(out)

    return part


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document and its edited text: the last half replaced by the first half as long of the next document.

    Documents are ordered by descending ``doc_id``, nulls last, rows of one id by text
    (nulls as empty); the next one of the last is the first, so a single row follows
    itself. One row per input row: doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next (likeness with the edited
    text's and the next document's fingerprint), common_edited and common_next (code points
    that the document shares from its start with either). Null texts count as empty; no
    rows give no rows; other columns are ignored, whatever their names.

    Texts are dealt once, by runs of ids, and streamed in order in each task; only the first
    document of a run is sent twice, as the last one's follower. All rows of one id are in
    one run.
    """
    parts = PARTS * shards_for(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    borders, followers = order_parts(rows.select("doc_id"), parts)
    if not followers:
        return docs.sparkSession.createDataFrame([], RESULT)
    part = part_of(borders)
    firsts = docs.sparkSession.createDataFrame(followers, "part int, first bigint, before int")  # a row for each part
    dealt = rows.withColumn("part", part("doc_id")).withColumn("follows", F.lit(False))
    sent = (dealt.join(F.broadcast(firsts), "part").where(F.col("doc_id").eqNullSafe(F.col("first")))
                 .groupBy(F.col("before").alias("part"), "doc_id").agg(F.min("text").alias("text")).withColumn("follows", F.lit(True)))
    ordered = (dealt.unionByName(sent).repartition(shards_for(docs), "part")
                    .sortWithinPartitions("part", "follows", F.desc_nulls_last("doc_id"), "text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []  # the last document of the rows before, whose next isn't known yet
        held = 0
        for batch in groups(batches):
            for i, t, follows in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "follows"))):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if len(ids) > 1 and (follows or held >= GROUP):
                    yield compared(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
                    held = len(texts[0])
                if follows:
                    ids, texts, held = [], [], 0

    return ordered.select("doc_id", "text", "follows").mapInArrow(read, RESULT)
