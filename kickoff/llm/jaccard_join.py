"""N-gram Jaccard join: near-duplicate classes of documents by rare-first prefix filtering.

A document's set is its distinct word shingles; documents of equal sets form a class
(one key), and only classes are compared. Two sets of similarity t share a shingle among
the first n - ceil(t n) + 1 of each in any common order; with the rarest shingles first
these prefixes seldom meet by chance.

* Order: shingles that tasks meet often are counted over all documents; the most frequent
  (a bounded table) come last, by count, all others first, by hash. Any total order
  keeps the result whole; this one keeps frequent passages out of the prefixes.
* Prefix entries (shingle, class, size, place) meet on the shingle. Those met by one
  class only are dropped at once.
* Candidates pass the length filter, the positional filter (shared so far plus what is
  left behind both places; only the latter in the last round and in ``jaccard_links``, at
  a pair's first common shingle) and the suffix filter (sets cut into parts by hash range:
  the overlap is at most the sum of the smaller part sizes), and are verified once per
  pair on both sets, at 64 bits a shingle. Only classes of pairs that passed the filters
  get a set, from one document each, found by a Bloom filter of those documents' ids.
* A large group of near copies would give the square of its size in pairs. So links come
  in rounds: in each group of a shingle, members are held against one pivot of another
  component, a document against its best pivot only; components grow; then every pair
  that is still between two components and wasn't verified yet is. Pairs within a
  component can't change the result and are skipped, no others are. That holds for the
  components (``near_duplicates``); ``jaccard_links`` verifies and gives all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_MAX_ROWS, is_small
from ..session import scratch_path, scratch_scope
from .common import (
    BLANKS, ROWS_A_FILE, byte_values, mix, rolling, settled, shards_for, shared_folder, shuffles_removed, slices, stored, text_buffer, unused, words_of,
)

#: Most frequent shingles that are ordered by their count (16 bytes each).
FREQUENT = 1 << 20
#: A task reports a shingle that this many of its documents have.
LOCAL_COUNT = 16
#: Shingles of a part of a set in the suffix filter, about; small sets have 64 parts.
PART = 4
#: Rounds against pivots before all remaining pairs are compared.
PIVOT_ROUNDS = 4
#: Most words of 64 bits of the Bloom filter of documents whose sets are read, bits of it for an id, and bits an id sets.
BLOOM_WORDS, BLOOM_BITS, BLOOM_PROBES = 1 << 20, 32, 4
#: Classes of a shingle that a task holds against all others of the shingle.
SALTED = 1024


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words are one shingle, none none."""
    data, offsets = text_buffer(column)
    h, row, _, _ = words_of(data, offsets, byte_values(BLANKS, lower=True))
    starts = np.searchsorted(row, np.arange(len(column) + 1))
    grams = rolling(h, k)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            out.append(mix(rolling(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of n and m elements at this similarity: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def signature(shingles: np.ndarray) -> bytes:
    """Sizes of the set's parts by hash range, a byte each (255 stands for any size from there)."""
    bits = max(6, (len(shingles) // PART - 1).bit_length())
    return np.minimum(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """What two sets can have in common by the sizes of their parts; the longer signature is folded to the shorter."""
    s, t = (np.frombuffer(z, np.uint8).astype(np.int64) for z in sorted((x, y), key=len))
    s[s == 255], t[t == 255] = 1 << 40, 1 << 40
    return int(np.minimum(s, t.reshape(len(s), -1).sum(axis=1)).sum())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_shingles(rows: DataFrame, k: int) -> np.ndarray:
    """The (at most FREQUENT) most frequent shingles, as hashes in ascending order of their counts."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for part in slices(iter([batch])) for s in shingle_sets(part.column("text"), k)]
            if not sets:
                continue
            h = np.concatenate(sets)
            slot = (h >> np.uint64(42)).astype(np.int64)
            h = h[np.bincount(slot, minlength=1 << 22)[slot] >= LOCAL_COUNT]  # no other can have the count
            found, counts = np.unique(h, return_counts=True)
            some = counts >= LOCAL_COUNT
            yield pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(counts[some], pa.int64())], names=["h", "n"])

    counts = rows.select("text").mapInArrow(local, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).withColumn(
        "_b", F.floor(F.log2("n") * 16)).checkpoint()
    room, least = FREQUENT, None
    for r in counts.groupBy("_b").count().orderBy(F.desc("_b")).collect():  # at most 16 x 64 rows
        room -= r["count"]
        if room < 0:
            break
        least = r["_b"]
    if least is None:
        return np.empty(0, np.uint64)
    got = counts.where(F.col("_b") >= least).select("h", "n").toArrow()  # at most FREQUENT rows of 16 bytes
    h, n = got["h"].to_numpy(), got["n"].to_numpy()
    return h[np.lexsort((h, n))].view(np.uint64)


def class_key(shingles: np.ndarray) -> int | None:
    """64 bits that stand for a set; None for the empty one."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """Per document: size and class key; part sizes for the class's first document in a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), k)
            keys = [class_key(s) for s in sets]
            sigs = [None if key is None or key in seen else (seen.add(key), signature(s))[1] for key, s in zip(keys, sets)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary())],
                                             names=["doc_id", "n_shingles", "cls", "sig"])

    return rows.mapInArrow(read, "doc_id bigint, n_shingles bigint, cls bigint, sig binary")


def prefix(shingles: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The set's first n - ceil(t n) + 1 shingles: the unlisted by hash, then the frequent by their rank."""
    length = len(shingles) - -(-percent * len(shingles) // 100) + 1
    rare = np.flatnonzero(order == 0)
    if len(rare) < length:
        late = np.flatnonzero(order)
        rare = np.concatenate((rare, late[np.argsort(order[late], kind="stable")]))
    return shingles[rare[:length]]


#: Prefix entries that a task packs together.
PACKED = 1 << 20


def shared_entries(rows: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(h, cls, pos): the prefix entries whose shingle more than one class has in its prefix.

    Entries travel packed by hash range, a row per task and range (10 to 16 bytes an entry
    instead of 40), and are unpacked where a range meets; shingles are compared by 48 bits
    and the range there, which can only add candidates.
    """
    ranked = np.argsort(frequent)
    sent = rows.sparkSession.sparkContext.broadcast((frequent[ranked], ranked.astype(np.uint64) + np.uint64(1)))
    ranges = 2 * shards_for(rows)

    def packed(hs: list, classes: list) -> pa.RecordBatch:
        h = np.concatenate(hs)
        lengths = np.asarray([len(x) for x in hs])
        pos = np.concatenate([np.arange(n) for n in lengths])
        pos = pos.astype("<u2" if lengths.max() <= 65536 else "<u4")
        cls = np.repeat(np.asarray(classes, dtype="<i8"), lengths)
        part = ((h >> np.uint64(48)) * np.uint64(ranges)) >> np.uint64(16)
        order = np.argsort(part, kind="stable")  # within a range by document: classes come in runs
        names, first = np.unique(part[order], return_index=True)
        low = h[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        cuts = [*first.tolist(), len(h)]
        blobs = [[column[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] for column in (low, cls[order], pos[order])]
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=["part", "h", "cls", "pos"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = sent.value
        seen: set[int] = set()
        hs, classes, held = [], [], 0
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), k)
            flat = np.concatenate(sets)
            order = np.zeros(len(flat), np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                order = np.where(known[at] == flat, rank[at], order)
            first = 0
            for s in sets:
                own = order[first:first + len(s)]
                first += len(s)
                key = class_key(s)
                if key is not None and key not in seen:
                    seen.add(key)
                    hs.append(prefix(s, own, percent))
                    classes.append(key)
                    held += len(hs[-1])
            if held >= PACKED:
                yield packed(hs, classes)
                hs, classes, held = [], [], 0
        if hs:
            yield packed(hs, classes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []

        def met() -> pa.RecordBatch:
            low = np.frombuffer(b"".join(b[0] for b in blobs), np.uint8).reshape(-1, 6)
            h = np.zeros((len(low), 8), np.uint8)
            h[:, :6] = low
            h = h.view("<u8").ravel()
            cls = np.frombuffer(b"".join(b[1] for b in blobs), "<i8")
            pos = np.concatenate([np.frombuffer(b[2], "<u2" if 4 * len(b[2]) == len(b[1]) else "<u4").astype(np.int64) for b in blobs])
            order = np.lexsort((cls, h))
            h, cls, pos = h[order], cls[order], pos[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            last = np.append(first[1:], len(h)) - 1
            some = np.repeat(cls[first] != cls[last], last - first + 1)
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])))  # a class met in several tasks counts once
            some &= fresh
            full = h[some].astype(np.int64) | (np.int64(part) << np.int64(48))
            return pa.RecordBatch.from_arrays([pa.array(full), pa.array(cls[some]), pa.array(pos[some])], names=["h", "cls", "pos"])

        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "h", "cls", "pos"))):
                if p != part and blobs:
                    yield met()
                    blobs = []
                part = p
                blobs.append(row)
        if blobs:
            yield met()

    dealt = rows.select("text").mapInArrow(pack, "part int, h binary, cls binary, pos binary").repartition(shards_for(rows), "part")
    return dealt.sortWithinPartitions("part").mapInArrow(meet, "h bigint, cls bigint, pos bigint")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp): the smallest class key that each of ``nodes`` (cls, comp) reaches over ``links`` (a, b) between them.

    Labels spread along links and then jump to their label's label; nothing but columns
    of keys is shuffled, and a node with very many links is pre-aggregated. Labels are
    written as tables: what the planner knows of a checkpoint's columns (its constraints)
    piles up from step to step, and planning would take longer with each.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels, n = settled(nodes.select("cls", "comp"), "labels")
    while True:
        seen = both.join(labels.select(F.col("cls").alias("b"), F.col("comp").alias("_c")), "b").groupBy("a").agg(F.min("_c").alias("_m"))
        spread = labels.join(seen.withColumnRenamed("a", "cls"), "cls", "left").select("cls", "comp", F.least("comp", F.coalesce("_m", "comp")).alias("_new"))
        # a label that fell takes its holders along: they ask the node that the old label names
        fell = spread.where("_new < comp").groupBy(F.col("comp").alias("_old")).agg(F.min("_new").alias("_to"))
        moved = stored(spread.join(fell, F.col("_new") == F.col("_old"), "left").select("cls", F.col("comp").alias("_was"), F.least("_new", F.coalesce("_to", "_new")).alias("comp")).coalesce(1 + n // ROWS_A_FILE), "labels")
        labels = moved.select("cls", "comp")
        if moved.where("comp <> _was").isEmpty():
            return labels


def bloom(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter over the column ``doc_id`` of ``n`` rows, of at most BLOOM_WORDS words; more ids only let more others pass."""
    length = min(BLOOM_WORDS, 1 + n * BLOOM_BITS // 64)
    bits = 64 * length
    probes = [F.pmod(F.xxhash64(F.lit(i), F.coalesce("doc_id", F.lit(0))), F.lit(bits)) for i in range(BLOOM_PROBES)]
    set_bits = ids.select(F.explode(F.array(*probes)).alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
    got = set_bits.toArrow()  # at most BLOOM_WORDS rows of 12 bytes
    words = np.zeros(length, np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    return words


def sets_of(rows: DataFrame, sent: Broadcast[np.ndarray], k: int) -> DataFrame:
    """(cls, shingles): the sorted set of the class of each document that the filter ``sent`` lets pass."""
    bits = 64 * len(sent.value)
    probes = [F.pmod(F.xxhash64(F.lit(i), F.coalesce("doc_id", F.lit(0))), F.lit(bits)).alias(f"p{i}") for i in range(BLOOM_PROBES)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            some = np.ones(batch.num_rows, bool)
            for i in range(BLOOM_PROBES):
                bit = batch.column(f"p{i}").to_numpy()
                some &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
            for part in slices(iter([batch.select(["text"]).filter(pa.array(some))])):
                found = [(key, s.astype("<u8").tobytes()) for s in shingle_sets(part.column("text"), k) if (key := class_key(s)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["cls", "shingles"])

    return rows.select("text", *probes).mapInArrow(read, "cls bigint, shingles binary")


PAIRS = "center bigint, member bigint"
#: With a document of each side.
READ_PAIRS = f"{PAIRS}, d_center bigint, d_member bigint"


def possible(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The suffix filter: the pairs (center, member) whose parts' sizes allow the similarity, with a document of each."""

    def by_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(f"n_{c}").to_numpy() for c in ("center", "member"))
            most = np.asarray([most_shared(x, y) for x, y in zip(batch.column("s_center").to_pylist(), batch.column("s_member").to_pylist())], np.int64)
            yield batch.select(["center", "member", "d_center", "d_member"]).filter(pa.array(most >= needed(n, m, percent)))

    side = lambda c: sigs.select(F.col("cls").alias(c), F.col("sig").alias(f"s_{c}"), F.col("n_shingles").alias(f"n_{c}"), F.col("doc_id").alias(f"d_{c}"))
    return pairs.select("center", "member").join(side("center"), "center").join(side("member"), "member").mapInArrow(by_parts, READ_PAIRS)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (center, member) whose sets are similar, given ``sets`` (cls, shingles; a class may come twice).

    Members' sets meet their center's, which is held while they pass by; a center of
    many members is dealt over tasks.
    """
    centers = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("n"))
    at = lambda held, cls, salt, late: held.select(F.col(cls).alias("cls"), "center", salt.alias("salt"), F.lit(late).alias("late"))
    meet = at(pairs.select("center", "member").join(centers, "center"), "member", F.pmod(F.xxhash64("member"), "n").cast("int"), True).unionByName(
        at(centers, "center", F.explode(F.sequence(F.lit(0), F.col("n") - 1)), False))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = np.empty(0, np.uint64), None
        for batch in batches:
            found = []
            for center, cls, late, shingles in zip(*(batch.column(c).to_pylist() for c in ("center", "cls", "late")), batch.column("shingles")):
                if not late:
                    own, last = np.frombuffer(shingles.as_py(), "<u8"), None
                elif cls != last:
                    other, last = np.frombuffer(shingles.as_buffer(), "<u8"), cls
                    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    if (own[place] == other).sum() >= needed(len(own), len(other), percent):
                        found.append((center, cls))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["center", "member"])

    if is_small(pairs, BROADCAST_MAX_ROWS // 2):  # at most as many rows for the centers as for the members
        meet = F.broadcast(meet)
    met = sets.join(meet, "cls").repartition("center", "salt").sortWithinPartitions("center", "salt", "late", "cls")
    return met.select("center", "cls", "late", "shingles").mapInArrow(compare, PAIRS)


class Verifier:
    """Tells the similar pairs among candidates (center, member)."""

    def __init__(self, rows: DataFrame, sigs: DataFrame, k: int, percent: int):
        self.rows, self.sigs, self.k, self.percent = rows, sigs, k, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """The similar ones as (a, b), a < b, stored."""
        pairs, n = settled(possible(pairs, self.sigs, self.percent), "possible")
        if n:
            wanted = pairs.select(F.explode(F.array("d_center", "d_member")).alias("doc_id"))
            sent = self.rows.sparkSession.sparkContext.broadcast(bloom(wanted, 2 * n))
            pairs, _ = settled(similar(pairs, sets_of(self.rows, sent, self.k), self.percent), "similar")
            sent.destroy()  # else every executor keeps a copy on its disk
        return pairs.select(F.least("center", "member").alias("a"), F.greatest("center", "member").alias("b"))


def _compared(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, Verifier]:
    """(members by document, prefix entries that classes share, what verifies pairs of classes)."""
    shared_folder(docs.sparkSession)
    rows = _texts(docs)
    members = _sets(rows, k).checkpoint()
    sigs = members.where("sig IS NOT NULL").groupBy("cls").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("doc_id")).checkpoint()
    members = members.drop("sig")

    # np: size and place in one number
    shared = shared_entries(rows, k, percent, frequent_shingles(rows, k)).join(sigs.select("cls", "n_shingles"), "cls").select("h", "cls", (F.shiftleft("n_shingles", 32) + F.col("pos")).alias("np"), "n_shingles")
    # w: the part of a class's prefix that others share; near 1 in the middle of a group of near copies
    length = F.col("n_shingles") - F.ceil(F.lit(percent / 100) * F.col("n_shingles")) + 1
    shared = shared.select("h", "cls", "np", (F.count(F.lit(1)).over(Window.partitionBy("cls")) / length).cast("float").alias("w")).checkpoint()
    return members, shared, Verifier(rows, sigs, k, percent)


def fits(x: str, y: str, percent: int, first: bool = False):
    """Length and positional filter of two entries of one shingle; of their sets' ``first`` common one, if asked.

    Nothing is shared before the first common shingle, so only what is left behind both places
    counts. Similar sets pass there, and it lies in both prefixes.
    """
    size = lambda c: F.shiftright(c, 32)
    place = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    n, m = size(x), size(y)
    least = F.ceil(F.lit(percent) * (n + m) / (100 + percent))
    before = F.lit(0) if first else F.least(place(x), place(y))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (before + F.least(n - place(x), m - place(y)) >= least)


def sharing(entries: DataFrame, percent: int, between: str | None = None) -> DataFrame:
    """(center, member): the pairs of classes with a common entry that the filters leave, each once.

    ``between`` names a column in which the two must differ. A shingle that many classes
    share is dealt over tasks: one side by class, the other to each of them.
    """
    own = ["h", "cls", "np", *([between] if between else [])]
    held = entries.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("_n"))
    dealt = entries.select(*own).join(held, "h")
    left = dealt.withColumn("_s", F.pmod(F.xxhash64("cls"), "_n").cast("int")).select("_s", "h", *[F.col(c).alias(f"{c}_a") for c in own[1:]])
    right = dealt.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("_s", "h", *[F.col(c).alias(f"{c}_b") for c in own[1:]])
    apart = F.col(f"{between}_a") != F.col(f"{between}_b") if between else F.lit(True)
    met = left.join(right, ["h", "_s"]).where((F.col("cls_a") < F.col("cls_b")) & apart & fits("np_a", "np_b", percent, first=True))
    return met.select(F.col("cls_a").alias("center"), F.col("cls_b").alias("member")).distinct()


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(links, members): every pair of classes that are similar, and each document's class.

    Links are (a, b), a < b, one row per pair of different sets of ``percent`` similarity or
    more; members are (doc_id, n_shingles, cls), one row per input row, documents of equal
    sets share a class, null and word-less texts have none. Every candidate pair is verified
    once, whatever links it to others, so a group of m near copies gives up to m * m / 2
    rows. A shingle that many classes share is dealt over tasks: one side by class, the
    other to each of them.
    """
    with shuffles_removed(docs.sparkSession):
        members, shared, verifier = _compared(docs, k, percent)
        return verifier.links(sharing(shared, percent)), members


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per input row.

    ``component_id`` is the smallest doc_id reachable over links (percent of similarity or
    more), itself included. Null and word-less texts have empty sets and link with
    nothing. A null id is nobody's smallest id while another is there; repeated rows are
    copies of each other; no rows give no rows; other columns are ignored. Shingles are
    compared by hashes of 64 bits.
    """
    with shuffles_removed(docs.sparkSession):
        members, shared, verifier = _compared(docs, k, percent)
        group = Window.partitionBy("h")
        labels = shared.select("cls").distinct().select("cls", F.col("cls").alias("comp")).checkpoint()
        tried = None
        for turn in range(PIVOT_ROUNDS):
            # the class that most of its prefix connects to others; other ones of these in later rounds
            luck = 1 - F.pmod(F.xxhash64(F.lit(turn), "cls"), F.lit(1024)) / (2048 if turn else 1 << 20)
            pivot = F.max(F.struct((F.col("w") * luck).alias("key"), F.col("cls").alias("pc"), F.col("np").alias("pnp"), "comp")).over(group)
            marked = shared.join(labels, "cls") if turn else shared.withColumn("comp", F.col("cls"))
            held = marked.withColumn("_p", pivot).withColumn("_low", F.min("comp").over(group)).withColumn("_top", F.max("comp").over(group)).where("_low < _top").select(
                "h", "cls", "np", "w", "comp", "_p.pc", "_p.pnp", F.col("_p.comp").alias("pcomp"))
            if turn:  # shingles within one component have no more to tell
                held = held.checkpoint()
                shared = held.select("h", "cls", "np", "w")
            near = held.where((F.col("comp") != F.col("pcomp")) & fits("np", "pnp", percent)).groupBy("cls", "pc").agg(F.count(F.lit(1)).alias("_n"))
            pairs = near.select(F.col("pc").alias("center"), F.col("cls").alias("member"), "_n")
            if tried is not None:
                pairs = untried(pairs, tried)
            pairs, n = settled(pairs.groupBy("member").agg(F.max_by("center", F.struct("_n", "center")).alias("center")), "pairs")
            if not n:
                break
            tried = pairs if tried is None else tried.unionByName(pairs)
            before, labels = labels, _merge(labels, verifier.links(pairs))
            if labels is before:
                break
        # what is left: every unverified pair between two components
        rest = sharing(shared.join(labels, "cls"), percent, "comp")
        labels = _merge(labels, verifier.links(rest if tried is None else untried(rest, tried)))

    classes = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    smallest = classes.join(labels, "cls", "left").select("cls", "doc_id", F.coalesce("comp", "cls").alias("comp"))
    least = smallest.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = smallest.join(least, "comp").select("cls", "component_id")
    with_class = members.where("cls IS NOT NULL").join(named, "cls").select("doc_id", "n_shingles", "component_id")
    return with_class.unionByName(members.where("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """``pairs`` without those tried, whichever of the two was the center."""
    known = tried.select("center", "member").unionByName(tried.select(F.col("member").alias("center"), F.col("center").alias("member")))
    return pairs.join(known, ["center", "member"], "left_anti")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components that ``links`` (a, b) connect; the same ones without links."""
    if links.isEmpty():
        return labels
    of = lambda c: labels.select(F.col("cls").alias(c), F.col("comp").alias(f"_{c}"))
    path = scratch_path(labels.sparkSession, "labels")
    with scratch_scope():  # the steps' tables go with the merge
        between, _ = settled(links.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct(), "between")
        nodes = between.select(F.col("a").alias("cls")).unionByName(between.select(F.col("b").alias("cls"))).distinct().select("cls", F.col("cls").alias("comp"))
        joined = components(nodes, between).select(F.col("cls").alias("_old"), F.col("comp").alias("_new"))
        return stored(labels.join(joined, F.col("comp") == F.col("_old"), "left").select("cls", F.coalesce("_new", "comp").alias("comp")), "labels", path)


def keep_smallest(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents (all columns, whatever their names) without those whose class has a smaller document.

    Repeated rows of one id are one document and stay together; rows without an id stay,
    and so do null and word-less texts. An empty table gives no rows.
    """
    gone_id, = unused(docs, "_gone")
    gone = near_duplicates(docs, k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
