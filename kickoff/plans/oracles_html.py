"""Oracle SQL for the HTML extraction round trips: the rows the pages were built from."""

from __future__ import annotations

from .oracles import sql
from .oracles_clean import STANDINGS

SEASON = "CAST(season_year AS VARCHAR) || '-' || CAST(season_year + 1 AS VARCHAR)"


@sql("extract_fixtures", "matches")
def _():
    return f"""
SELECT league, {SEASON} AS season, CAST(match_date AS VARCHAR) AS date,
       CASE WHEN ISODOW(match_date) IN (6, 7) THEN '17:00' ELSE '20:00' END AS time, home_team, away_team,
       CASE WHEN result IS NULL THEN '' ELSE CAST(CAST(home_goals AS INTEGER) AS VARCHAR) || '–' || CAST(CAST(away_goals AS INTEGER) AS VARCHAR) END AS score,
       venue, '' AS attendance,
       CASE WHEN result IS NULL THEN NULL ELSE CAST(home_goals AS INTEGER) END AS home_goals,
       CASE WHEN result IS NULL THEN NULL ELSE CAST(away_goals AS INTEGER) END AS away_goals,
       CASE WHEN result IS NULL THEN 'Unknown' WHEN result = 1 THEN 'Home Win' WHEN result = -1 THEN 'Away Win' ELSE 'Draw' END AS result
FROM matches
"""


@sql("extract_standings", "matches")
def _():
    return STANDINGS + """
SELECT league, season, ordinal, team, played, wins, draws, losses, goals_for, goals_against,
       CASE WHEN ordinal = 3 THEN NULL ELSE points END AS points
FROM snap
"""
