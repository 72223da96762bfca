"""Standings snapshots: build, display, store per season, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import scalars as S
from ..operators.history import team_unpivot

STANDINGS_SCHEMA = StructType([
    StructField("team", StringType()), StructField("played", LongType()), StructField("wins", LongType()),
    StructField("draws", LongType()), StructField("losses", LongType()), StructField("goals_for", LongType()),
    StructField("goals_against", LongType()), StructField("points", LongType()),
])


def standings_snapshot(matches: DataFrame) -> DataFrame:
    """Final standings rows per (league, season) with the snapshot ordinal."""
    apps = team_unpivot(matches, extra=["season_year"])
    played = F.col("result").isNotNull()
    cnt = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    t = apps.groupBy("league", "season_year", "team").agg(
        cnt(played).alias("played"), cnt(F.col("points") == 3).alias("wins"),
        cnt(F.col("points") == 1).alias("draws"), cnt(F.col("points") == 0).alias("losses"),
        F.sum(F.when(played, F.col("gf"))).cast("bigint").alias("goals_for"),
        F.sum(F.when(played, F.col("ga"))).cast("bigint").alias("goals_against"),
        F.sum(F.when(played, F.col("points")).otherwise(0)).cast("bigint").alias("points"))
    w = Window.partitionBy("league", "season_year").orderBy(
        F.desc("points"), F.desc(F.coalesce(F.col("goals_for") - F.col("goals_against"), F.lit(0))), "team")
    return (t.withColumn("ordinal", F.row_number().over(w))
             .withColumn("season", S.season_label("season_year")).drop("season_year"))


def standings_display(snapshot: DataFrame) -> DataFrame:
    """position = row number in snapshot order; gd = goals_for - goals_against (null-propagating)."""
    w = Window.partitionBy("league", "season").orderBy("ordinal")
    return snapshot.select("league", "season", "team", "played", "wins", "draws", "losses", "goals_for",
                           "goals_against", "points", F.row_number().over(w).alias("position"),
                           (F.col("goals_for") - F.col("goals_against")).alias("gd"))


def sink_standings(snapshot: DataFrame, path: str, partition_cols=("season",)) -> None:
    """Replace the snapshot of the seasons present in ``snapshot``; other seasons stay.

    Dynamic partition overwrite on the season directory (optionally nested
    under league).
    """
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).json(path)


def scan_standings_json(spark: SparkSession, path: str, season: str | None = None) -> DataFrame:
    """Read stored snapshots; ``season`` prunes to one partition directory."""
    schema = StructType(list(STANDINGS_SCHEMA.fields)
                        + [StructField("league", LongType()), StructField("ordinal", LongType()),
                           StructField("season", StringType())])
    df = spark.read.schema(schema).json(path)
    return df.where(F.col("season") == season) if season is not None else df
