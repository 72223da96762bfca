"""A bounded sample of labelled rows for fitting classifiers, and models fitted in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id as text) modulo 4 whose labels are never learned from.
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is held out; a null id has no label to learn and isn't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, label): at most ``limit`` labelled documents for each of the labels 0 and 1, none held out.

    The rows are those with the least hashes of their ids. The chosen ids (bounded) are
    broadcast, so the documents are only scanned.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("_lid"), F.col(label).cast("int").alias("label")).where(
        F.col("_lid").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("_lid"))).distinct()
    ids = [usable.where(F.col("label") == v).orderBy(F.xxhash64("_lid"), "_lid").limit(limit) for v in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))  # at most 2 x limit rows
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        chosen, F.col("doc_id") == F.col("_lid")).select("doc_id", "text", "label")


def fitted(sample: DataFrame, fit: Callable[[list[str], list[int]], object]) -> object:
    """``fit(texts, labels)`` run in one task over the sample (rows in the order of their ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["text"], r["label"]) for b in batches for r in b.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return fit([], []) if found is None else pickle.loads(found["model"])  # no labelled rows
