"""Packing documents into fixed-length token sequences by cutting-stock column generation.

1. Tokenise. A document is its ids and one end id. It is cut into full pieces of the
   sequence length and one rest; a full piece is a sequence of its own. Per piece only
   its place, length and the checksum of its ids go on; the ids stay in the task.
2. Histogram of rest lengths, in classes of STEP tokens (rounded up): a bounded table.
3. Column generation in one task over that table. Master: cover the demand of every class with as few
   sequences as possible, a linear program over patterns (how many rests of each class
   one sequence takes), started from patterns of one class each. Its duals price new
   patterns by an integer knapsack, solved by dynamic programming, until no pattern
   improves it. The histogram has at most length / STEP classes at any corpus size, so
   the program's size is bounded.
4. Rounding: patterns are used floor(x) times; the (few) left-over pieces of the classes
   are filled into sequences, the largest first.
5. Ranked documents take their places: within a class the rests are numbered (in two
   levels, no window holds a class), and each pattern owns a range of these numbers.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, slices
from .token_counts import SETTLED

#: Tokens of a length class.
STEP = 8
#: Sub-groups in which the rests of a class are numbered.
RANK_BUCKETS = 256
#: Parts of texts whose ids a task keeps; beyond it they are forgotten and looked up anew.
MEMO = 300_000


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class PartIds(dict):
    """Ids of blank-separated, lower-case parts as little-endian 32-bit bytes, found when first asked for."""

    def __init__(self, model, pattern: str):
        super().__init__()
        self.model, self.find, self.letters = model, regex.compile(pattern).findall, byte_letters()

    def __missing__(self, part: str) -> bytes:
        words = (part,) if part.isalpha() else self.find(part)  # letters alone are one word
        if len(words) == 1:
            letters = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            found = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        else:
            found = b"".join([self[w] for w in words])
        if len(self) >= MEMO:
            self.clear()
        self[part] = found
        return found


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, by blank-separated parts where the tokenizer allows it.

    A tokenizer that drops white space and never joins what it separates gives a text the
    ids of its parts, one after the other; each distinct part is then looked up once.
    """

    #: Fixed: the split pattern of the files this holds for.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Characters on which Python's split() or lower() and the tokenizer's may differ.
    ODD = re.compile("[\x1c-\x1f\x85İ]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])]
        cutters = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_part = (sys.byteorder == "little" and array("I").itemsize == 4 and steps == ["NFC", "Replace", "Lowercase"]
                        and [c["type"] for c in cutters] == ["Split", "ByteLevel"] and cutters[0]["pattern"].get("Regex") == self.PATTERN
                        and cutters[0]["invert"] and not cutters[1]["use_regex"] and not cutters[1]["add_prefix_space"])
        self.special = [t["content"] for t in kind["added_tokens"]]
        self.settled = regex.compile(SETTLED.replace("ͯ", "˿"))  # no combining marks: such texts are in NFC already
        self.parts = PartIds(self.tokenizer.model, self.PATTERN)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_part or not (text.isascii() or self.settled.fullmatch(text)) or self.ODD.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.parts.__getitem__, text.lower().split()))


def document_pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens per piece: full pieces and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for part in slices(batches):
            ids, starts, sizes, crcs, totals = [], [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                tokens = words.ids(text or "") + end
                n = len(tokens) // 4
                for at in range(0, n, length):
                    piece = tokens[4 * at:4 * (at + length)]
                    ids.append(doc_id)
                    starts.append(at)
                    sizes.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, crcs, totals)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded integer knapsack by dynamic programming: (value, items taken of each size)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, room, side="right"))
        best[room] = best[room - 1]
        if k:
            sums = best[room - sizes[:k]] + values[:k]
            i = int(np.argmax(sums))
            if sums[i] > best[room] + 1e-12:
                best[room], took[room] = sums[i], i
    counts = np.zeros(len(sizes), dtype=np.int64)
    room = capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray, int]:
    """(patterns as columns, uses, priced columns that entered) of the cutting-stock linear program, by a revised simplex.

    The start holds a pattern of each size alone. In each round the knapsack prices a
    pattern against the duals; it enters the basis, or the program is done: by Farley's
    bound its value is within ``gap`` of the optimum once the best pattern's is at most
    1 + gap, and it is too once the uses are that near to the tokens over the capacity.
    Demands are raised by tiny, different amounts, so every entering pattern lowers the
    uses and no basis returns; the uses come from the true demands at the end. A run that
    doesn't settle raises an error.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / (capacity // sizes))
    raised = demand * (1 + 1e-7 * np.arange(1, m + 1) / m)
    uses = inverse @ raised
    least = float(sizes @ demand) / capacity
    priced = 0
    while uses.sum() > (1 + gap) * least:
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        able = direction > 1e-9
        if priced >= 1000 * (m + 1) or not able.any():
            raise RuntimeError(f"column generation hasn't settled after {priced} patterns for {m} sizes")
        ratio = np.full(m, np.inf)
        ratio[able] = np.maximum(uses[able], 0) / direction[able]
        out = int(np.argmin(ratio))
        move = ratio[out]
        uses = uses - move * direction
        uses[out] = move
        basis[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        priced += 1
        if priced % 100 == 0:  # against rounding errors
            inverse = np.linalg.inv(basis)
            uses = inverse @ raised
    return np.rint(basis).astype(np.int64), np.maximum(np.linalg.solve(basis, demand), 0), priced


def fill(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Pieces of each size for one sequence: the largest that is left, then the fullest choice of the others that are left."""
    taken = np.zeros(len(sizes), dtype=np.int64)
    top = int(np.flatnonzero(left)[-1])
    taken[top] = 1
    room = capacity - int(sizes[top])
    while (some := np.flatnonzero((left > taken) & (sizes <= room))).size:
        own = sizes[some]
        counts = np.minimum(best_pattern(own * (1 + own / (1000.0 * capacity)), own, room)[1], (left - taken)[some])
        taken[some] += counts
        room -= int(counts @ own)
    return taken


def plan_sequences(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern as {size: count}, times)] that holds exactly ``demand`` pieces of each size.

    The program's patterns are used as often as whole numbers allow; the pieces that are
    left, fewer than patterns times pieces in one, are filled into sequences one by one.
    """
    if not len(sizes):
        return []
    unit = int(np.gcd.reduce(np.append(sizes, capacity)))  # the knapsack's grid
    patterns, uses, _ = column_generation(sizes // unit, demand.astype(float), capacity // unit)
    left = demand.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    take = lambda taken, times: out.append(({int(sizes[i]): int(taken[i]) for i in np.flatnonzero(taken)}, times))
    for j in np.argsort(-uses, kind="stable"):
        taken = patterns[:, j]
        some = taken > 0
        times = int(min(np.floor(uses[j] + 1e-9), (left[some] // taken[some]).min())) if some.any() else 0
        if times > 0:
            left -= times * taken
            take(taken, times)
    while left.any():
        taken = fill(sizes // unit, left, capacity // unit)
        times = int((left[taken > 0] // taken[taken > 0]).min())
        left -= times * taken
        take(taken, times)
    return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, step: int = STEP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Every id of every document (its text's ids and ``end_id``) lies in exactly one piece;
    sequences hold at most ``length`` ids, offsets are gapless from 0. A null text is
    empty (one piece: the end id). Repeated rows and ids are packed each for itself, null
    ids are kept, an empty table gives no rows, other columns are ignored.
    """
    shared_folder(docs.sparkSession)
    # the pieces are numbered below: all later reads must meet the same rows
    pieces = document_pieces(docs, tokenizer_path, length, end_id).withColumn(
        "_size", F.least(F.ceil(F.col("length") / step) * step, F.lit(length)).cast("bigint")).withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")).checkpoint()
    # full pieces and rests alike are numbered per class: bucket totals first, then places within a bucket
    counted = pieces.groupBy("_size", "_bucket").count()
    before = Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(counted.select("_size", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")))  # classes x buckets
    within = Window.partitionBy("_size", "_bucket").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")
    ranked = pieces.join(starts, ["_size", "_bucket"]).withColumn("_rank", F.col("_start") + F.row_number().over(within) - 1)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram: dict[int, int] = {}
        for batch in batches:
            histogram |= dict(zip(batch.column("_size").to_pylist(), batch.column("n").to_pylist()))
        sizes = np.asarray(sorted(histogram), dtype=np.int64)
        ranges, next_rank, next_sequence = [], dict.fromkeys(histogram, 0), 0
        for pattern, times in plan_sequences(sizes, np.asarray([histogram[int(s)] for s in sizes], dtype=np.int64), length):
            for size, count in pattern.items():
                ranges.append((size, next_rank[size], next_rank[size] + times * count, count, next_sequence))
                next_rank[size] += times * count
            next_sequence += times
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in ranges], pa.int64()) for i in range(5)], names=["_size", "_from", "_to", "_count", "_sequence"])

    # one row a class: length / step of them at most; the program is solved in one task
    histogram = counted.groupBy("_size").agg(F.sum("count").alias("n")).coalesce(1)
    # at most classes x patterns rows, patterns at most classes + left-over sequences
    table = histogram.mapInArrow(plan, "_size bigint, _from bigint, _to bigint, _count bigint, _sequence bigint")
    placed = ranked.join(F.broadcast(table), "_size").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).withColumn(
        "sequence_id", F.col("_sequence") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_count")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_size"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("bigint")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
