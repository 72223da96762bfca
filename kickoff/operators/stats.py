"""Aggregations, quality profile, top-k and leaderboard ranking.

All aggregations are ``groupBy``/``agg`` (partial + final hash aggregation);
windows only run over already-aggregated rows (a few per season or team).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from .history import team_unpivot
from .ranking import global_index


def team_statistics(matches: DataFrame) -> DataFrame:
    """11 metrics per team; losses = total - wins - draws (unplayed count as losses)."""
    apps = team_unpivot(matches)
    cnt = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    t = apps.groupBy("team").agg(
        F.count(F.lit(1)).alias("total_matches"),
        cnt(F.col("is_home")).alias("home_matches"),
        cnt(~F.col("is_home")).alias("away_matches"),
        cnt(F.col("points") == 3).alias("wins"),
        cnt(F.col("points") == 1).alias("draws"),
        F.coalesce(F.sum("gf"), F.lit(0.0)).alias("goals_scored"),
        F.coalesce(F.sum("ga"), F.lit(0.0)).alias("goals_conceded"))
    return (t.withColumn("losses", F.col("total_matches") - F.col("wins") - F.col("draws"))
             .withColumn("goal_difference", F.col("goals_scored") - F.col("goals_conceded"))
             .withColumn("win_percentage", F.col("wins") / F.col("total_matches") * 100.0)
             .withColumn("goals_per_match", F.col("goals_scored") / F.col("total_matches")))


def season_counts(df: DataFrame) -> DataFrame:
    """Matches per (league, season) and a flag when below the expected minimum."""
    return (df.groupBy("league", "season_year").agg(F.count(F.lit(1)).alias("matches"))
              .withColumn("low_count", F.col("matches") < C.LOW_SEASON_COUNT))


def result_distribution(df: DataFrame) -> DataFrame:
    """Count per result class with share of known results and of all rows; plus missing."""
    named = df.select(F.coalesce(S.result_to_name("result"), F.lit("Missing")).alias("result_class"),
                      F.col("result").isNotNull().alias("known"))
    g = named.groupBy("result_class", "known").agg(F.count(F.lit(1)).alias("matches"))
    w_all = Window.partitionBy()  # over the <= 4 aggregated rows
    return g.select(
        "result_class", "matches",
        F.when(F.col("known"), F.col("matches") * 100.0 /
               F.sum(F.when(F.col("known"), F.col("matches"))).over(w_all)).alias("pct_of_known"),
        (F.col("matches") * 100.0 / F.sum("matches").over(w_all)).alias("pct_of_all"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column: null count and percentage, only columns with at least one null."""
    n = F.count(F.lit(1))
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(n.alias("_rows"), *aggs)
    stacked = wide.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in df.columns])).alias("kv"))
    return (stacked.select("kv.column_name", "kv.missing", (F.col("kv.missing") * 100.0 / F.col("_rows")).alias("pct"))
            .where(F.col("missing") > 0))


def unique_team_count(df: DataFrame) -> DataFrame:
    teams = df.select(F.col("home_team").alias("t")).union(df.select(F.col("away_team").alias("t")))
    return teams.agg(F.count_distinct("t").alias("unique_teams"))


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))


def latest_season(df: DataFrame, season_col: str = "season") -> DataFrame:
    """The greatest season label and its match count."""
    latest = df.agg(F.max(season_col).alias("latest_season"))
    return (df.join(latest, F.col(season_col) == F.col("latest_season"), "inner")
              .groupBy("latest_season").agg(F.count(F.lit(1)).alias("matches")))


def scrape_summary(df: DataFrame, season_col: str = "season") -> DataFrame:
    """Matches per season with the running total in season order and the grand total."""
    per = df.groupBy(season_col).agg(F.count(F.lit(1)).alias("matches"))
    w = Window.orderBy(season_col)  # over one row per season
    return per.select(season_col, "matches",
                      F.sum("matches").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_total"),
                      F.sum("matches").over(Window.partitionBy()).alias("grand_total"))


def quality_report(df: DataFrame) -> DataFrame:
    """All quality checks as one long table (section, item, value): duplicates, matches per
    season, seasons with too few (value 1), teams, results and missing values, both as
    counts and as percentages (of known results, of all rows)."""
    dup = (df.groupBy("match_date", "home_team", "away_team").agg(F.count(F.lit(1)).alias("c"))
             .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("double").alias("value"))
             .select(F.lit("duplicates").alias("section"), F.lit("duplicate_matches").alias("item"), "value"))
    seasons = season_counts(df).select(F.lit("season_counts").alias("section"),
                                       F.concat_ws(":", F.col("league").cast("string"),
                                                   S.season_label("season_year")).alias("item"),
                                       F.col("matches").cast("double").alias("value"))
    teams = unique_team_count(df).select(F.lit("teams").alias("section"), F.lit("unique_teams").alias("item"),
                                         F.col("unique_teams").cast("double").alias("value"))
    h = df.select(F.col("home_team").alias("team")).distinct()
    a = df.select(F.col("away_team").alias("team")).distinct()
    only = (h.join(a, "team", "left_anti").select(F.lit("home_only").alias("item"), "team")
            .union(a.join(h, "team", "left_anti").select(F.lit("away_only").alias("item"), "team")))
    only = only.select(F.lit("teams").alias("section"), F.concat_ws(":", "item", "team").alias("item"),
                       F.lit(1.0).alias("value"))
    low = season_counts(df).where("low_count").select(F.lit("low_season_counts").alias("section"),
                                                      F.concat_ws(":", F.col("league").cast("string"), S.season_label("season_year")).alias("item"), F.lit(1.0).alias("value"))
    both = lambda section, item, count, pct: F.explode(F.array(
        F.struct(F.lit(section).alias("section"), F.col(item).alias("item"), F.col(count).cast("double").alias("value")),
        F.struct(F.lit(f"{section}_pct").alias("section"), F.col(item).alias("item"), F.col(pct).cast("double").alias("value")))).alias("x")
    res = result_distribution(df).select(both("results", "result_class", "matches", "pct_of_known")).select("x.*").where("value IS NOT NULL")
    miss = missing_profile(df).select(both("missing", "column_name", "missing", "pct")).select("x.*")
    return dup.union(seasons).union(low).union(teams).union(only).union(res).union(miss)


# ------------------------------------------------------------ top-k

def top_teams(stats: DataFrame, k: int = 5) -> DataFrame:
    """Top k teams by win percentage (ties: team ascending) - TakeOrderedAndProject."""
    return stats.orderBy(F.desc("win_percentage"), F.asc("team")).limit(k)


def first_k_per_season(matches: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("league", "season_year").orderBy("match_date", "home_team", "away_team")
    return matches.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def leaderboard_entries(users: DataFrame) -> DataFrame:
    """Users -> entries: ordinal i = 1-based rank of user_id; null points -> 1000 - 10 i."""
    ordered = global_index(users, ["user_id"], "_i")
    i = F.col("_i") + 1
    return ordered.select(
        F.col("user_id").cast("string").alias("user_id"), "username",
        F.coalesce(F.col("points").cast("bigint"), (F.lit(1000) - i * 10).cast("bigint")).alias("total_points"),
        F.coalesce(F.col("correct_predictions").cast("bigint"), F.lit(0).cast("bigint")).alias("correct_predictions"),
        i.alias("ordinal"))


def leaderboard_rank(entries: DataFrame) -> DataFrame:
    """position 1..n by points descending, ties in input (ordinal) order.

    Whole-population ranking with a distributed sort (no single-task window).
    """
    ranked = global_index(entries, [F.desc("total_points"), F.asc("ordinal")], "_p")
    return ranked.withColumn("position", F.col("_p") + 1).drop("_p")


def leaderboard_podium(entries: DataFrame) -> DataFrame:
    return (entries.orderBy(F.desc("total_points"), F.asc("ordinal")).limit(3)
            .select("username", "total_points"))
