"""Conversation prefix trie: which conversations share their first turns, by adaptive radix trees.

A turn's id is a fixed number of bytes (WIDTH, big-endian: the MD5 of its role and text), a
conversation's key the ids of its turns one after the other. Keys go into radix trees whose
nodes have room for 4, 16, 48 or 256 children and grow when full; a run of bytes without
branches is one compressed path. A tree branches at any byte, but only depths that are
a whole number of turns are nodes of the result.

Equal conversations are one key, with their number, smallest id and the hash of their
ids. Keys are dealt over tasks by ranges of their order, at borders that are keys
themselves, so no first turn or conversation however common makes one task's tree large.
Only nodes on the path to a border can have members in two ranges: each range gives its
part of them, additive, and Spark sums those parts. A range knows the next one's first
key, which tells it what goes on there.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shards_for, stored

#: Bytes of a turn's id.
WIDTH = 16
#: Bytes of keys in a range, about, if that gives more ranges than there are shuffle partitions.
RANGE_BYTES = 4 << 20
#: Keys looked at per border, and the most bytes of one that may become a border.
SAMPLED, BORDER_BYTES = 8, 1024
#: Ids joined to one text before a group's ids are brought together.
JOINED = 4096

NO_ENDS = hashlib.sha256(b"").hexdigest()


class Node:
    """Compressed path, children by their first byte, and the number of the key that ends here.

    ``keys`` are the children's bytes in order, beside ``slots`` (up to 4, then up to 16 children);
    or an index from byte to slot (up to 48, 255 is none); or nothing, and ``slots`` has a place
    for each byte. ``some`` is the number of a key below.
    """

    __slots__ = ("path", "keys", "slots", "room", "value", "some")

    def __init__(self, path: bytes, value: int | None, some: int):
        self.path, self.value, self.some = path, value, some
        self.keys, self.slots, self.room = bytearray(), [], 4

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            i = self.keys.find(byte)
            return self.slots[i] if i >= 0 else None
        if self.room == 48:
            i = self.keys[byte]
            return self.slots[i] if i != 255 else None
        return self.slots[byte]

    def add(self, byte: int, node: Node) -> None:
        if self.room < 256 and len(self.slots) == self.room:
            self.grow()
        if self.room <= 16:
            i = bisect.bisect(self.keys, byte)
            self.keys.insert(i, byte)
            self.slots.insert(i, node)
        elif self.room == 48:
            self.keys[byte] = len(self.slots)
            self.slots.append(node)
        else:
            self.slots[byte] = node

    def grow(self) -> None:
        children = list(self.children())
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            self.room, self.keys = 48, bytearray(b"\xff" * 256)
            for i, (byte, _) in enumerate(children):
                self.keys[byte] = i
        else:
            self.room, self.keys, self.slots = 256, None, [None] * 256
            for byte, node in children:
                self.slots[byte] = node

    def children(self) -> Iterator[tuple[int, Node]]:
        """(byte, node) in byte order."""
        if self.room <= 16:
            return zip(self.keys, self.slots)
        if self.room == 48:
            return ((byte, self.slots[i]) for byte, i in enumerate(self.keys) if i != 255)
        return ((byte, node) for byte, node in enumerate(self.slots) if node is not None)

    def split(self, at: int) -> None:
        """Cuts the path: what was here moves to a child behind the first ``at`` bytes."""
        low = Node(self.path[at + 1:], self.value, self.some)
        low.keys, low.slots, low.room = self.keys, self.slots, self.room
        byte = self.path[at]
        self.path, self.value, self.keys, self.slots, self.room = self.path[:at], None, bytearray(), [], 4
        self.add(byte, low)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Bytes that a has in common with b from ``start`` of b."""
    n = min(len(a), len(b) - start)
    if b.startswith(a[:n], start):
        return n
    low, high = 0, n  # the first ``low`` are alike, the first ``high`` are not
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if b.startswith(a[:middle], start) else (low, middle)
    return low


class Tree:
    """An adaptive radix tree of distinct keys."""

    def __init__(self):
        self.root: Node | None = None

    def add(self, key: bytes, number: int) -> None:
        if self.root is None:
            self.root = Node(key, number, number)
            return
        node, at = self.root, 0
        while True:
            same = common(node.path, key, at)
            if same < len(node.path):
                node.split(same)
            at += same
            if at == len(key):
                node.value = number
                return
            child = node.child(key[at])
            if child is None:
                node.add(key[at], Node(key[at + 1:], number, number))
                return
            node, at = child, at + 1

    def turns(self, width: int) -> Iterator[tuple[int, int, int, int | None]]:
        """(depth in turns, number of the parent among those given, a key below, the key that ends here), parents first."""
        given = 0
        if self.root is not None:
            ends = self.root.value if not self.root.path else None
            yield 0, -1, self.root.some, ends
            given = 1
            left = [(self.root, 0, len(self.root.path), 0)]  # node, bytes above it and with it, the turn above it
        while given and left:
            node, above, below, parent = left.pop()
            for depth in range(above // width + 1, below // width + 1):
                yield depth, parent, node.some, node.value if depth * width == below else None
                parent, given = given, given + 1
            left.extend((child, below, below + 1 + len(child.path), parent) for _, child in node.children())


NODES = ("node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, ends_sha256 string")
_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]


def range_nodes(keys: list[bytes], stats: list[tuple[int, int, str, list[int]]], first: bytes, after: bytes | None) -> Iterator[pa.RecordBatch]:
    """Result rows of one range of keys, each with (smallest conversation, number, hash of their ids, words by turn).

    ``first`` is the border that the range starts at, ``after`` the next range's first key.
    Nodes on the paths to both have a ``node`` key: their rows are this range's parts. Rows
    whose parent is such a node name it by ``parent``.
    """
    tree = Tree()
    for number, key in enumerate(keys):
        tree.add(key, number)
    depths, parents, some, ends = (list(x) for x in zip(*tree.turns(WIDTH)))
    size = len(depths)
    n, least = [0] * size, [None] * size
    children, leaves, saved, there = [0] * size, [0] * size, [0] * size, [False] * size
    edge, goes_on = [False] * size, [False] * size
    for i in range(size):
        if i == 0 or edge[parents[i]]:
            key, at = keys[some[i]], depths[i] * WIDTH
            goes_on[i] = after is not None and after.startswith(key[:at])
            edge[i] = i == 0 or goes_on[i] or first.startswith(key[:at])
    for i in range(size - 1, -1, -1):
        if ends[i] is not None:
            conv, count = stats[ends[i]][:2]
            n[i] += count
            least[i] = conv if least[i] is None else min(least[i], conv)
            if not there[i] and not goes_on[i]:
                leaves[i] += 1
        words = stats[some[i]][3][depths[i] - 1] if depths[i] else 0
        saved[i] += n[i] * words - (0 if goes_on[i] else words)  # the last range that has a node takes its one own copy off
        if (up := parents[i]) >= 0:
            n[up] += n[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            leaves[up] += leaves[i]
            saved[up] += saved[i]
            there[up] = True
            children[up] += not goes_on[i]

    def name(i: int) -> bytes:
        return hashlib.md5(keys[some[i]][:depths[i] * WIDTH]).digest()

    names = [name(i) if edge[i] else None for i in range(size)]
    above = [names[p] if p >= 0 else None for p in parents]
    over = [least[p] if p >= 0 and not edge[p] else None for p in parents]
    done = [stats[e][2] if e is not None else None if edge[i] else NO_ENDS for i, e in enumerate(ends)]
    columns = (names, above, depths, least, over, n, children, leaves, saved, done)
    for a in range(0, size, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[a:a + (1 << 16)], t) for c, t in zip(columns, _TYPES)], names=[c.split()[0] for c in NODES.split(", ")])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words by turn) of every conversation, its first turns taken from its family's first one.

    Turns go by ``turn``, null first, then by id. With h = crc32 of the decimal conv_id, modulo 4:
    the first h turns of conversation c - c % 20, then c's own turns after its first h.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    c = F.col("conv_id").cast("bigint")
    turns = conversations.where(c.isNotNull()).select(
        (c - c % 20).alias("base"), c.alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.md5(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))).alias("id"),
        F.regexp_count(text("text"), F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    own = lambda df: df.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("t")).select(
        "base", "conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))
    first = own(turns.where("conv_id = base")).select("base", F.slice("ids", 1, 3).alias("_ids"), F.slice("words", 1, 3).alias("_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    joined = own(turns.repartition("base")).join(first, "base", "left").withColumn("h", h)
    taken = lambda x: F.concat(F.coalesce(F.expr(f"slice(_{x}, 1, h)"), F.expr(f"slice({x}, 1, 0)")), F.expr(f"slice({x}, h + 1, greatest(size({x}) - h, 0))"))
    return joined.select("conv_id", F.unhex(F.array_join(taken("ids"), "")).alias("key"), taken("words").alias("words"))


def ended(ids: DataFrame) -> DataFrame:
    """(end, conv_id, n, ends_sha256) of (end, conv_id): each group's smallest id, size, and the hash of its ids.

    Ids are dealt by ranges; in each, a group's ids become texts of up to JOINED, which then
    meet by group and are hashed in order, one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((e, c) for batch in batches for e, c in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist()))
        out = []
        for end, group in itertools.groupby(rows, key=lambda r: r[0]):
            while some := [c for _, c in itertools.islice(group, JOINED)]:
                out.append((end, some[0], len(some), ",".join(map(str, some))))
                if len(out) >= 4096:
                    yield _batch(out, [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["end", "conv_id", "n", "ids"])
                    out = []
        yield _batch(out, [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["end", "conv_id", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out = []
        for end, group in itertools.groupby(rows, key=lambda r: r[0]):
            total, least, digest = 0, None, hashlib.sha256()
            for _, first, n, text in group:
                digest.update((("," if total else "") + text).encode())
                total, least = total + n, first if least is None else least
            out.append((end, least, total, digest.hexdigest()))
            if len(out) >= 4096:
                yield _batch(out, [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["end", "conv_id", "n", "ends_sha256"])
                out = []
        yield _batch(out, [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["end", "conv_id", "n", "ends_sha256"])

    shards = shards_for(ids)
    texts = ids.repartitionByRange(shards, "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(join, "end binary, conv_id bigint, n bigint, ids string")
    return texts.repartition(shards, "end").sortWithinPartitions("end", "conv_id").mapInArrow(hashed, "end binary, conv_id bigint, n bigint, ends_sha256 string")


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def borders(keys: DataFrame, ranges: int) -> list[bytes]:
    """First keys of all ranges but the lowest, ascending: some of the keys of at most BORDER_BYTES."""
    few = keys.where(F.octet_length("key").between(1, BORDER_BYTES)).select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLED * ranges).collect()
    return sorted(bytes(r.key) for r in few)[::SAMPLED][1:]


def prefix_trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """The trie of all rebuilt conversations (see ``rebuilt``), a row per distinct sequence of first turns.

    conv_id (smallest member), depth (turns; the root has 0), parent_conv_id (the parent's
    conv_id, null for the root), n_convs (members: conversations that start with the
    sequence), n_children, n_leaves (childless nodes in the subtree, itself included),
    saved_tokens (over the subtree: members less one, times words of the last text), and
    ends_sha256 (of the ascending, comma-joined ids of the members that end here). Null
    roles and texts count as empty; rows without a conv_id belong to no conversation and are
    left out; repeated rows are repeated turns; no rows give no rows, not even a root; other
    columns are ignored. A conversation's ids and word counts, 20 bytes a turn, meet in one row.
    """
    spark = conversations.sparkSession
    sequences = stored(rebuilt(conversations).withColumn("end", F.unhex(F.md5("key"))), "rebuilt-conversations")
    keys = stored(ended(sequences.select("end", "conv_id")).drop("end").join(sequences.drop("end"), "conv_id"), "distinct-conversations")
    held = keys.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    starts = borders(keys, ranges or max(shards_for(conversations), math.ceil(held / RANGE_BYTES)))

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect.bisect(starts, bytes(k))).astype("int32")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "conv_id", "n", "ends_sha256", "words"))))
        for i, group in itertools.groupby(rows, key=lambda r: r[0]):
            found, stats = [], []
            for _, key, *rest in group:
                found.append(key)
                stats.append(tuple(rest))
            yield from range_nodes(found, stats, starts[i - 1] if i else b"", starts[i] if i < len(starts) else None)

    dealt = keys.withColumn("range", place("key")).repartition(shards_for(keys), "range").sortWithinPartitions("range", "key")
    nodes = stored(dealt.select("range", "key", "conv_id", "n", "ends_sha256", "words").mapInArrow(build, NODES), "trie-nodes")

    added = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    edge = nodes.where("node IS NOT NULL").groupBy("node", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), *added, F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256")).withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    rows = nodes.where("node IS NULL").unionByName(edge)
    named = rows.where("parent IS NOT NULL").drop("parent_conv_id").join(edge.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    every = rows.where("parent IS NULL").unionByName(named)
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
