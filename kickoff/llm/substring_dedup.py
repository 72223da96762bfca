"""Removal of long repeated passages by prefix-partitioned suffix trees.

A window (``window`` consecutive words) of a document is a repeat if its word sequence
also starts in a document with a smaller id; every word under such a window goes.

1. Prefix counting. Of all suffixes (word positions), each document marks those whose
   ``PREFIX``-word prefix has the least hash of the prefixes inside some window: every
   window has a marked suffix, at the same place in each of its copies. A marked prefix
   that only one document has makes all windows that it marks unique; the others are
   counted over the corpus (shingle hash, least and greatest document).
2. Contexts. For each marked suffix with a repeated prefix, a document emits the words
   from the first to the last window that it marks. Equal contexts are one, with their
   least document.
3. Suffix trees. Contexts are split by the prefix of their marked suffix into groups of
   bounded size. A task sorts the suffixes (window starts) of its groups by their words;
   neighbours' common prefixes are the internal nodes of the suffix tree, those of depth
   ``window`` or more are the repeats, and a node's least document decides. A prefix with
   more contexts than fit is lengthened: its windows are grouped by all their words,
   a plain aggregation.
4. The repeated windows of a document become spans of words, and the kept words its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, byte_values, rolling, shared_folder, shards_for, slices, stored, text_buffer, text_key, words_of

#: Words of the prefix that splits the suffixes first.
PREFIX = 8
#: Contexts of one prefix that go into one tree; a prefix with more is lengthened.
GROUP = 4_000
#: Suffixes sorted at a time (of whole groups).
TREE_SUFFIXES = 60_000
#: Stands for a null id: no document's id is greater, and it is never the smaller document.
NO_ID = (1 << 63) - 1


def marks(h: np.ndarray, starts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marked suffixes of texts given by word hashes and the first word of each text.

    Returns, per marked suffix: its position, its prefix's hash, and the first and last
    start of the windows that it marks (a run, as a window's leftmost least prefix is its mark).
    """
    span = window - k + 1  # prefixes inside a window
    n = len(h)
    lengths = np.diff(starts)
    counts = np.maximum(lengths - window + 1, 0)
    total = int(counts.sum())
    none = np.empty(0, np.int64)
    if not total:
        return none, np.empty(0, np.uint64), none, none
    grams = rolling(h, k)
    # least prefix hash of each window: sliding minimum by doubling; positions by the leftmost equal
    least = grams.copy()
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:len(least) - size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
    first = np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)  # window starts
    value = least[first]
    # leftmost position with that value: walk over positions of equal hash by a forward search
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    group = np.searchsorted(ranked, value)  # first entry of the value
    position = order[group]
    late = position < first
    if late.any():  # the value occurs more than once in this slice: the first at or after the start
        key = np.zeros(len(ranked), dtype=np.int64)
        key[1:] = np.cumsum(ranked[1:] != ranked[:-1])
        joint = key * (n + 1) + order
        at = np.searchsorted(joint, key[group[late]] * (n + 1) + first[late])
        position[late] = order[at]
    cut = np.flatnonzero(np.concatenate(([True], (position[1:] != position[:-1]) | (first[1:] != first[:-1] + 1))))
    last = np.append(cut[1:], total) - 1
    return position[cut], value[cut], first[cut], first[last]


def _read(column: pa.Array):
    data, offsets = text_buffer(column)
    h, row, start, end = words_of(data, offsets, byte_values(BLANKS))
    return data, h, np.searchsorted(row, np.arange(len(column) + 1)), start, end


def _spread(bounds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """bounds[i], bounds[i] + 1, ... sizes[i] of them, for all i."""
    total = int(sizes.sum())
    return np.repeat(bounds - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total)


def deep_nodes(suffixes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each suffix (a row of word numbers) the least owner among the suffixes equal to it to full depth.

    The rows are sorted; where two neighbours' common prefix has the whole depth they hang
    under one internal node of the suffix tree, and a run of such neighbours is its leaves.
    """
    keys = np.ascontiguousarray(suffixes.astype(">u4")).view(f"S{4 * suffixes.shape[1]}").ravel()
    order = np.argsort(keys, kind="stable")
    ranked = suffixes[order]
    differs = ranked[1:] != ranked[:-1]
    depth = np.where(differs.any(axis=1), differs.argmax(axis=1), suffixes.shape[1])  # common words of neighbours
    node = np.flatnonzero(np.concatenate(([True], depth < suffixes.shape[1])))
    least = np.minimum.reduceat(owners[order], node)
    out = np.empty_like(owners)
    out[order] = np.repeat(least, np.diff(np.append(node, len(owners))))
    return out


def _trees(window: int):
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        suffixes = 0

        def solved(rows: list[tuple]) -> pa.RecordBatch:
            number: dict[bytes, int] = {}
            words = [np.fromiter((number.setdefault(w, len(number) + 1) for w in r[1].split(b" ")), dtype=np.int64) for r in rows]
            flat = np.concatenate(words).astype(np.int32)
            first = np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1]))
            sizes = np.asarray([len(w) - window + 1 for w in words])
            at = _spread(first, sizes)
            least = deep_nodes(flat[at[:, None] + np.arange(window)], np.repeat([r[2] for r in rows], sizes))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(least, pa.int64()))],
                names=["ctx", "least"])

        group = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ctx", "words", "owner", "prefix")]
            for ctx, text, owner, prefix in zip(*columns):
                if prefix != group and suffixes >= TREE_SUFFIXES:
                    yield solved(held)
                    held, suffixes = [], 0
                group = prefix
                held.append((ctx, text, owner))
                suffixes += text.count(b" ") + 2 - window
        if held:
            yield solved(held)

    return trees


def _kept(text: str | None, starts: np.ndarray, window: int) -> tuple[int, int, int, bytes]:
    """(words, words removed, spans removed, kept words joined) of a text and its repeated windows."""
    words = (text or "").encode().split()
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    kept = [words[i] for i in np.flatnonzero(~gone)] if len(starts) else words
    return len(words), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), b" ".join(kept)


DONE = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def _done(doc_ids: list, found: list[tuple[int, int, int, bytes]], with_text: bool) -> list[pa.Array]:
    return [pa.array(doc_ids, pa.int64()), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3)),
            pa.array([hashlib.sha256(f[3]).hexdigest() for f in found], pa.string()),
            pa.array([f[3].decode() if with_text else None for f in found], pa.string())]


def remove_repeats(docs: DataFrame, window: int = 50, prefix: int = PREFIX, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256, kept (the text; null unless ``with_text``), one row per input row.

    Null texts have no words. A null id is nobody's smaller document, and every document
    that has an id is smaller than it; of rows with one id none removes from another.
    Texts shorter than the window keep all words, an empty table gives no rows, other
    columns are ignored. Words are kept byte for byte and joined by one space.
    """
    shared_folder(docs.sparkSession)
    k = min(prefix, window)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_key", text_key(F.col("text")))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, h, starts, _, _ = _read(part.column("text"))
            position, value, _, _ = marks(h, starts, window, k)
            row = np.searchsorted(starts, position, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(part.column("_id").to_numpy()[row]), pa.array((position - starts[row]).astype(np.int32))], names=["prefix", "_id", "pos"])

    marked = rows.select("_id", "text").mapInArrow(mark, "prefix bigint, _id bigint, pos int")
    repeated = marked.groupBy("prefix").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo < _hi").select("prefix")
    # equal texts: all windows of all but the first are repeats, only the first is searched
    keys = rows.select("_id", "_key")
    firsts = keys.groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    copies = keys.join(firsts, "_key").where("_id > _first")
    facts = marked.join(repeated, "prefix").select("_id", "pos", F.lit(None).cast("binary").alias("_copy")).unionByName(
        copies.select("_id", F.lit(None).cast("int").alias("pos"), F.col("_key").alias("_copy")))
    of_doc = facts.groupBy("_id").agg(F.collect_set("pos").alias("_marks"), F.collect_set("_copy").alias("_copies"))  # of one document

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that are copies or have no repeated prefix are done; the others go on."""
        for part in slices(batches):
            ids, inner, keys, texts, marked, copied = (part.column(c).to_pylist() for c in ("doc_id", "_id", "_key", "text", "_marks", "_copies"))
            found = []
            for i, text in enumerate(texts):
                if copied[i] and keys[i] in copied[i]:
                    n = len((text or "").encode().split())
                    found.append(_kept(text, np.arange(max(n - window + 1, 0)), window))
                    marked[i] = None
                else:
                    found.append(_kept(text, np.empty(0, np.int64), window) if not marked[i] else (0, 0, 0, b""))
                    texts[i] = text if marked[i] else None
                if not marked[i]:
                    texts[i] = None
            open_marks = [m or None for m in marked]
            yield pa.RecordBatch.from_arrays(
                [*_done(ids, found, with_text), pa.array(inner, pa.int64()), pa.array(keys, pa.binary()), pa.array(texts, pa.string()), pa.array(open_marks, pa.list_(pa.int32()))],
                names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "kept", "_id", "_key", "text", "marks"])

    looked = stored(rows.join(of_doc, "_id", "left").select("doc_id", "_id", "_key", "text", "_marks", "_copies").mapInArrow(
        first_look, f"{DONE}, _id bigint, _key binary, text string, marks array<int>"), "repeats-looked")
    done = looked.where("marks IS NULL").select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "kept")
    pending = looked.where("marks IS NOT NULL").select("doc_id", "_id", "_key", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, h, starts, begin, end = _read(part.column("text"))
            position, value, first, last = marks(h, starts, window, k)
            row = np.searchsorted(starts, position, side="right") - 1
            own = part.column("marks").to_pylist()  # none is null
            width = int(starts[-1]) + 1
            wanted = np.concatenate([np.asarray(m, dtype=np.int64) + i * width for i, m in enumerate(own)])
            keep = np.flatnonzero(np.isin(row * width + position - starts[row], wanted))
            lo, hi = first[keep], last[keep] + window - 1
            words = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(begin[lo].tolist(), end[hi].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[keep].view(np.int64)), part.column("_id").take(pa.array(row[keep])), part.column("_key").take(pa.array(row[keep])),
                 pa.array((lo - starts[row[keep]]).astype(np.int32)), pa.array(words, pa.binary()), pa.array((position[keep] - lo).astype(np.int32))],
                names=["prefix", "_id", "_key", "start", "words", "left"])

    contexts = pending.select("_id", "_key", "text", "marks").mapInArrow(cut, "prefix bigint, _id bigint, _key binary, start int, words binary, left int")
    contexts = stored(contexts.withColumn("ctx", F.unhex(F.md5(F.concat(F.col("words"), F.lit(" ").cast("binary"), F.col("left").cast("string").cast("binary"))))), "repeats-contexts")
    members = contexts.select("ctx", "_id", "_key", "start")
    distinct = stored(contexts.groupBy("ctx").agg(F.first("prefix").alias("prefix"), F.first("words").alias("words"), F.min("_id").alias("owner")), "repeats-distinct")
    crowded = distinct.groupBy("prefix").count().where(F.col("count") > GROUP).select("prefix")
    usual = distinct.join(crowded, "prefix", "left_anti")
    trees = usual.repartition(shards_for(docs), "prefix").sortWithinPartitions("prefix", "ctx").select("ctx", "words", "owner", "prefix").mapInArrow(
        _trees(window), "ctx binary, least array<bigint>")
    # lengthened prefixes: the windows of crowded ones by all their words
    split = distinct.join(crowded, "prefix").withColumn("_w", F.split(F.col("words").cast("string"), " "))
    long = split.select("ctx", "owner", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("_w") - window + 1), lambda i: F.unhex(F.sha2(F.array_join(F.slice("_w", i, window), " "), 256)))).alias("i", "_window"))
    least = long.groupBy("_window").agg(F.min("owner").alias("_least"))
    of_ctx = long.join(least, "_window").groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("i", "_least"))).alias("x"))  # windows of one context
    trees = trees.unionByName(of_ctx.select("ctx", F.transform("x", lambda x: x._least).alias("least")))
    # windows of a member that start in a smaller document
    hits = members.join(trees, "ctx").select("_id", "_key", F.filter(
        F.transform("least", lambda m, i: F.when(m < F.col("_id"), F.col("start") + i)), lambda p: p.isNotNull()).alias("at")).where(F.size("at") > 0)
    repeats = hits.groupBy("_id", "_key").agg(F.flatten(F.collect_list("at")).alias("_at"))  # windows of one document

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [_kept(text, np.unique(np.asarray(at or [], dtype=np.int64)), window) for text, at in zip(part.column("text").to_pylist(), part.column("_at").to_pylist())]
            yield pa.RecordBatch.from_arrays(_done(part.column("doc_id").to_pylist(), found, with_text),
                                             names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "kept"])

    finished = pending.join(repeats, ["_id", "_key"], "left").select("doc_id", "text", "_at").mapInArrow(finish, DONE)
    return done.unionByName(finished)
