"""A corpus pipeline over a table of documents: five stages, each an operator of ``kickoff.llm``.

``STAGES`` are (name, function) with function(spark, docs, sf_dir) -> DataFrame. ``run``
applies them in order; each stage's result is written to the shared folder and read back
as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kickoff.llm import decontaminate, jaccard_join, packing, quality_knn, secrets
from kickoff.llm.common import documents, stored
from kickoff.llm.queries import tokenizer_file

#: Documents that score below are rejected: all that aren't clearly nearer to good than to bad ones.
QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the nearest-neighbour classifier rejects; none without usable labels."""
    return quality_knn.keep_good(docs, documents(spark, sf_dir, "labels"), QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each near-duplicate component."""
    return jaccard_join.keep_smallest(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 2048, 1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]

#: The classifier, the exact spans and the packing can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
