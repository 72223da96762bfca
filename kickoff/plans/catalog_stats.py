"""Queries for aggregations, top-k and set operations (2.7 - 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sets as SE
from ..operators import stats as ST
from ..operators.history import MATCH_KEY
from .registry import query


def _labelled(t):
    return t.matches().withColumn("season", S.season_label("season_year"))


# ------------------------------------------------------------ 2.7 aggregations

@query("team_statistics")
def q_team_statistics(t):
    """Per team: matches (home/away), wins, draws, losses, goals, win %, goals per match."""
    return ST.team_statistics(t.matches())


@query("season_counts")
def q_season_counts(t):
    """Matches per (league, season) with the low-count flag."""
    return ST.season_counts(t.matches())


@query("result_distribution")
def q_result_distribution(t):
    """Count and share of each result class; missing results counted apart."""
    return ST.result_distribution(t.matches())


@query("missing_profile")
def q_missing_profile(t):
    """Null count and percentage for every column that has nulls."""
    return ST.missing_profile(t.matches())


@query("unique_team_count")
def q_unique_team_count(t):
    """Distinct teams in either role."""
    return ST.unique_team_count(t.matches())


@query("quality_report")
def q_quality_report(t):
    """Duplicates, season counts, teams, results and missing data as one long table."""
    return ST.quality_report(t.matches())


@query("date_range")
def q_date_range(t):
    """First and last match date."""
    return ST.date_range(t.matches())


@query("latest_season")
def q_latest_season(t):
    """Greatest season label and its match count."""
    return ST.latest_season(_labelled(t))


@query("scrape_summary")
def q_scrape_summary(t):
    """Matches per season, running total in season order, grand total."""
    return ST.scrape_summary(_labelled(t))


# ------------------------------------------------------------ 2.8 sort / top-k

@query("sort_by_date")
def q_sort_by_date(t):
    """Matches in chronological order by the total order key."""
    from ..operators.clean import sort_by_date
    return sort_by_date(t.matches())


@query("top_teams")
def q_top_teams(t):
    """Top 5 teams by win percentage."""
    return ST.top_teams(ST.team_statistics(t.matches())).select("team", "win_percentage", "goals_per_match")


@query("first_k_per_season")
def q_first_k(t):
    """First 3 matches of every (league, season) by order key."""
    return ST.first_k_per_season(t.matches()).select(*MATCH_KEY, "season_year", "rn")


@query("leaderboard_rank")
def q_leaderboard_rank(t):
    """Users ranked by points (null -> 1000 - 10 i), ties in input order."""
    return ST.leaderboard_rank(ST.leaderboard_entries(t.users()))


@query("leaderboard_podium")
def q_leaderboard_podium(t):
    """First three names and points of the leaderboard."""
    return ST.leaderboard_podium(ST.leaderboard_entries(t.users()))


# ------------------------------------------------------------ 2.9 sets

@query("teams_union")
def q_teams_union(t):
    """Home teams union away teams, sorted."""
    return SE.teams_union(t.matches()).orderBy("team")


@query("home_only")
def q_home_only(t):
    """Teams that never play away."""
    return SE.home_only(t.raw_matches().where(F.col("home_team").isNotNull()))


@query("away_only")
def q_away_only(t):
    """Teams that never play at home."""
    return SE.away_only(t.raw_matches().where(F.col("home_team").isNotNull()))


@query("union_seasons")
def q_union_seasons(t):
    """Season extracts written one folder per season, read back as one table."""
    from ..sources.files import union_season_extracts
    return union_season_extracts(t.spark, t.matches())


@query("slug_sources")
def q_slug_sources(t):
    """Distinct teams and non-empty venues with their slugs."""
    return SE.slug_sources(t.matches())
