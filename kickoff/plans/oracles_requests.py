"""Oracle SQL for prediction lookup and appended fixtures."""

from __future__ import annotations

from .oracles import MK, sql

SEASON = "CAST(season_year AS VARCHAR) || '-' || CAST(season_year + 1 AS VARCHAR)"


@sql("lookup_prediction", "predictions")
def _():
    return f""",
file AS (
  SELECT {SEASON} AS season, CAST(match_date AS VARCHAR) AS date, home_team, away_team,
         CAST(GREATEST(0, CAST(round_even(pred_home_goals, 0) AS BIGINT)) AS VARCHAR) AS pred_home_goals,
         CAST(GREATEST(0, CAST(round_even(pred_away_goals, 0) AS BIGINT)) AS VARCHAR) AS pred_away_goals,
         CAST(CAST(pred_result AS DOUBLE) AS VARCHAR) AS pred_result
  FROM predictions),
fo AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date, home_team, away_team) AS ordinal FROM file),
req AS (
  SELECT {MK}, '  ' || UPPER(home_team) || ' ' AS req_home, LOWER(away_team) AS req_away,
         CASE WHEN DAY(match_date) % 2 = 0 THEN CAST(match_date AS VARCHAR) END AS req_date
  FROM matches),
hit AS (
  SELECT r.league, r.match_date, r.home_team, r.away_team,
         arg_min({{'season': f.season, 'date': f.date, 'home_team': f.home_team, 'away_team': f.away_team,
                  'pred_home_goals': f.pred_home_goals, 'pred_away_goals': f.pred_away_goals,
                  'pred_result': f.pred_result}}, f.ordinal) AS p
  FROM req r JOIN fo f
    ON LOWER(TRIM(f.home_team)) = LOWER(TRIM(r.req_home)) AND LOWER(TRIM(f.away_team)) = LOWER(TRIM(r.req_away))
   AND (r.req_date IS NULL OR r.req_date = '' OR f.date = '' OR TRIM(f.date) = TRIM(r.req_date))
  GROUP BY ALL)
SELECT r.*, h.p.season AS pred_season, h.p.date AS pred_date, h.p.home_team AS pred_home_team,
       h.p.away_team AS pred_away_team, h.p.pred_home_goals, h.p.pred_away_goals, h.p.pred_result
FROM req r LEFT JOIN hit h USING (league, match_date, home_team, away_team)
"""
