"""Small tables for the document operators: a slice of the driver's, and odd rows."""

import random

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one long text, other scripts."""
    base = " ".join(words(120, 1))
    return [(1, base), (2, base), (2, base), (3, None), (None, base), (None, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "three short words"),
            (8, base.upper()), (9, "x" * 5000), (10, " ".join(words(6000, 2))), (11, "naïve “quotes” İstanbul ﬁ 漢字かな 한국어 é ſecret K"), (12, base + " tail " + " ".join(words(60, 3))),
            (13, "a b c\x1cd\x85e"), (14, "<|endoftext|> in <|startoftext|> text's 12 34"), (15, base.replace(" ", "\n"))]


def with_clashes(df):
    """Extra columns with names that the operators use themselves."""
    from pyspark.sql import functions as F
    for c in ("h", "cls", "_key", "_id", "n", "shard", "prefix", "size", "score", "_t", "_w", "n_words", "start", "length", "label", "marks"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def small_documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
