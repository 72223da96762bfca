"""Registered queries: one per operator of the survey inventory.

Each query takes ``Tables`` (the driver's parquet tables plus stand-in inputs
derived from them) and returns a lazy DataFrame. ``queries()`` wraps them in
the driver's ``(spark, sf_dir) -> DataFrame`` shape and rounds doubles to six
places, as the oracle SQL does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..fixtures import Tables
from ..session import configure

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog  # noqa: F401  (registers every query)

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return finish(fn(Tables(spark, sf_dir)))
        run.__doc__ = fn.__doc__
        return run

    return {name: wrap(fn) for name, fn in _QUERIES.items()}
