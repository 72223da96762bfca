"""Set operations over teams and venues (distinct / union / anti-join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import global_index


def teams_union(matches: DataFrame) -> DataFrame:
    """Teams seen in either role (sorted on output)."""
    return (matches.select(F.col("home_team").alias("team"))
            .union(matches.select(F.col("away_team").alias("team"))).distinct())


def home_only(matches: DataFrame) -> DataFrame:
    """Teams that never play away (left-anti join)."""
    h = matches.select(F.col("home_team").alias("team")).distinct()
    a = matches.select(F.col("away_team").alias("team")).distinct()
    return h.join(a, "team", "left_anti")


def away_only(matches: DataFrame) -> DataFrame:
    h = matches.select(F.col("home_team").alias("team")).distinct()
    a = matches.select(F.col("away_team").alias("team")).distinct()
    return a.join(h, "team", "left_anti")


def union_seasons(*extracts: DataFrame) -> DataFrame:
    """Concatenate season extracts by column name (missing columns -> null)."""
    out = extracts[0]
    for e in extracts[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def slug_sources(matches: DataFrame) -> DataFrame:
    """kind ('team' / 'stadium'), name, slug for distinct teams and non-empty venues."""
    teams = teams_union(matches).select(F.lit("team").alias("kind"), F.col("team").alias("name"))
    venues = (matches.select(F.col("venue").alias("name")).where(F.col("name").isNotNull() & (F.col("name") != ""))
              .distinct().select(F.lit("stadium").alias("kind"), "name"))
    return teams.union(venues).withColumn("slug", S.slugify("name"))


def teams_by_first_appearance(matches: DataFrame) -> DataFrame:
    """(team, ordinal): 0-based order of each team's first appearance, by the match
    order key, home side before away side within a match."""
    apps = (matches.select("league", "match_date", "home_team", "away_team",
                           F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("home_team").alias("team")),
                                             F.struct(F.lit(1).alias("side"), F.col("away_team").alias("team"))))
                           .alias("s"))
            .select("match_date", "home_team", "away_team", "s.side", "s.team"))
    first = apps.groupBy("team").agg(F.min(F.struct("match_date", "home_team", "away_team", "side")).alias("f"))
    first = first.select("team", "f.match_date", "f.home_team", "f.away_team", "f.side")
    return global_index(first, ["match_date", "home_team", "away_team", "side", "team"], "ordinal").select(
        "team", "ordinal")
