"""Helpers shared by the document operators: Arrow text access, vectorised words, row keys."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path

#: Python handles the texts of an Arrow batch in slices of about this many bytes.
SLICE_BYTES = 4 << 20
#: Bytes hashed at a time; a longer word lengthens its piece.
PIECE_BYTES = 1 << 20
#: Rows of numbers in a file of a ``settled`` table, about.
ROWS_A_FILE = 1 << 18
#: Spark's setting: an action's shuffle files go when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, ready for checkpoint()."""
    return checkpoint_dir(spark)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as a compressed table in the shared folder (at ``path``, if given), and read back: for rows with texts."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(``df``, a few numbers a row, stored in few files if it has few rows; its number of rows).

    What a shuffle returns lies in as many partitions with few rows as with many, and each
    later shuffle writes files for every one of them.
    """
    held = df.checkpoint()
    n = held.count()
    return stored(held.coalesce(1 + n // ROWS_A_FILE), name), n


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of actions on tables made inside go when the action ends, not when the
    driver happens to collect its garbage: for steps of many jobs."""
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: the grouping key of equal texts (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened by underscores until no column of ``df`` is called so (in either case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shards_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows of about SLICE_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = powers(base, max(n, PIECE_BYTES + 4096))
        if n <= 4 * PIECE_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_values(separators: bytes | set[int], lower: bool = False) -> np.ndarray:
    """256 random non-zero 64-bit values by byte, 0 for separators; A-Z as a-z if ``lower``."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


#: Space and \t \n \v \f \r.
BLANKS = {32, 9, 10, 11, 12, 13}


def words_of(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of bytes whose value isn't 0, within one row) of consecutive texts.

    Returns (hash uint64, row, start byte, end byte) per word. A hash is a polynomial
    in the word's byte values modulo 2**64, then mixed; it is computed piece by piece.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    breaks = offsets[:-1]
    hashes, starts, ends = [], [], []
    at = lo
    while at < hi:
        end = min(at + PIECE_BYTES, hi)
        while end < hi and values[data[end]] and values[data[end - 1]]:  # don't cut a word
            gap = np.flatnonzero(values[data[end:end + 65536]] == 0)
            end = end + int(gap[0]) if len(gap) else min(end + 65536, hi)
        c = values[data[at:end]]
        inside = c != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = breaks[np.searchsorted(breaks, at):np.searchsorted(breaks, end)] - at
        first[cut] |= inside[cut]
        cut = cut[cut > 0] - 1
        last[cut] |= inside[cut]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(c) + 1, dtype=np.uint64)
        np.cumsum(c * _powers(_ODD, len(c)), out=total[1:])
        hashes.append((total[e] - total[s]) * _powers(_INVERSE, len(c) + 1)[s])
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not hashes:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    start = np.concatenate(starts)
    return mix(np.concatenate(hashes)), np.searchsorted(offsets, start, side="right") - 1, start, np.concatenate(ends)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (len(h) - k + 1 of them, over row borders too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * _ODD + h[j:j + n]
    return mix(out)
