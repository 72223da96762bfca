"""Oracle SQL for aggregations, top-k, sets and sources/sinks."""

from __future__ import annotations

from .oracles import MK, sql
from .oracles_clean import SLUG, STANDINGS

SEASON = "CAST(season_year AS VARCHAR) || '-' || CAST(season_year + 1 AS VARCHAR)"

TEAM_STATS = """
SELECT team, total_matches, home_matches, away_matches, wins, draws, total_matches - wins - draws AS losses,
       goals_scored, goals_conceded, goals_scored - goals_conceded AS goal_difference,
       ROUND(wins / total_matches * 100.0, 6) AS win_percentage, ROUND(goals_scored / total_matches, 6) AS goals_per_match
FROM (
  SELECT team, COUNT(*) AS total_matches, SUM(CASE WHEN h THEN 1 ELSE 0 END) AS home_matches,
         SUM(CASE WHEN h THEN 0 ELSE 1 END) AS away_matches,
         SUM(CASE WHEN (h AND result = 1) OR (NOT h AND result = -1) THEN 1 ELSE 0 END) AS wins,
         SUM(CASE WHEN result = 0 THEN 1 ELSE 0 END) AS draws,
         COALESCE(SUM(gf), 0) AS goals_scored, COALESCE(SUM(ga), 0) AS goals_conceded
  FROM (SELECT home_team AS team, TRUE AS h, result, home_goals AS gf, away_goals AS ga FROM matches
        UNION ALL SELECT away_team, FALSE, result, away_goals, home_goals FROM matches)
  GROUP BY team)
"""


@sql("team_statistics", "matches")
def _():
    return TEAM_STATS


@sql("season_counts", "matches")
def _():
    return "SELECT league, season_year, COUNT(*) AS matches, COUNT(*) < 300 AS low_count FROM matches GROUP BY ALL"


RESULT_DIST = """
SELECT result_class, matches,
       ROUND(CASE WHEN result_class <> 'Missing' THEN matches * 100.0 / SUM(CASE WHEN result_class <> 'Missing' THEN matches END) OVER () END, 6) AS pct_of_known,
       ROUND(matches * 100.0 / SUM(matches) OVER (), 6) AS pct_of_all
FROM (SELECT CASE result WHEN 1 THEN 'Home Win' WHEN 0 THEN 'Draw' WHEN -1 THEN 'Away Win' ELSE 'Missing' END AS result_class,
             COUNT(*) AS matches FROM matches GROUP BY 1)
"""


@sql("result_distribution", "matches")
def _():
    return RESULT_DIST


MATCH_COLS = ["league", "match_date", "home_team", "away_team", "home_goals", "away_goals", "venue", "result",
              "season_year"]
MISSING = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing, "
    f"ROUND(COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0 / COUNT(*), 6) AS pct FROM matches" for c in MATCH_COLS
) + ") WHERE missing > 0"


@sql("missing_profile", "matches")
def _():
    return MISSING


@sql("unique_team_count", "matches")
def _():
    return "SELECT COUNT(DISTINCT t) AS unique_teams FROM (SELECT home_team AS t FROM matches UNION ALL SELECT away_team FROM matches)"


@sql("quality_report", "matches")
def _():
    return f"""
SELECT 'duplicates' AS section, 'duplicate_matches' AS item,
       CAST(COALESCE((SELECT SUM(c - 1) FROM (SELECT COUNT(*) AS c FROM matches GROUP BY match_date, home_team, away_team)), 0) AS DOUBLE) AS value
UNION ALL
SELECT 'season_counts', CAST(league AS VARCHAR) || ':' || {SEASON}, CAST(COUNT(*) AS DOUBLE) FROM matches GROUP BY league, season_year
UNION ALL
SELECT 'teams', 'unique_teams', CAST(COUNT(DISTINCT t) AS DOUBLE)
FROM (SELECT home_team AS t FROM matches UNION ALL SELECT away_team FROM matches)
UNION ALL
SELECT 'teams', 'home_only:' || team, 1.0 FROM (SELECT DISTINCT home_team AS team FROM matches EXCEPT SELECT DISTINCT away_team FROM matches)
UNION ALL
SELECT 'teams', 'away_only:' || team, 1.0 FROM (SELECT DISTINCT away_team AS team FROM matches EXCEPT SELECT DISTINCT home_team FROM matches)
UNION ALL
SELECT 'results', result_class, CAST(matches AS DOUBLE) FROM ({RESULT_DIST})
UNION ALL
SELECT 'results_pct', result_class, CAST(pct_of_known AS DOUBLE) FROM ({RESULT_DIST}) WHERE pct_of_known IS NOT NULL
UNION ALL
SELECT 'missing', column_name, CAST(missing AS DOUBLE) FROM ({MISSING})
UNION ALL
SELECT 'missing_pct', column_name, CAST(pct AS DOUBLE) FROM ({MISSING})
UNION ALL
SELECT 'low_season_counts', CAST(league AS VARCHAR) || ':' || {SEASON}, 1.0 FROM matches GROUP BY league, season_year HAVING COUNT(*) < 300
"""


@sql("date_range", "matches")
def _():
    return "SELECT MIN(match_date) AS first_date, MAX(match_date) AS last_date FROM matches"


@sql("latest_season", "matches")
def _():
    return f"""
SELECT season AS latest_season, COUNT(*) AS matches FROM (SELECT {SEASON} AS season FROM matches)
WHERE season = (SELECT MAX({SEASON}) FROM matches) GROUP BY season
"""


@sql("scrape_summary", "matches")
def _():
    return f"""
SELECT season, matches, SUM(matches) OVER (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_total,
       SUM(matches) OVER () AS grand_total
FROM (SELECT {SEASON} AS season, COUNT(*) AS matches FROM matches GROUP BY 1)
"""


@sql("sort_by_date", "matches")
def _():
    return "SELECT * FROM matches ORDER BY league, match_date, home_team, away_team"


@sql("top_teams", "matches")
def _():
    return f"SELECT team, win_percentage, goals_per_match FROM ({TEAM_STATS}) ORDER BY win_percentage DESC, team LIMIT 5"


@sql("first_k_per_season", "matches")
def _():
    return f"""
SELECT {MK}, season_year, rn FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY league, season_year ORDER BY match_date, home_team, away_team) AS rn FROM matches)
WHERE rn <= 3
"""


ENTRIES = """
entries AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, username,
         CAST(COALESCE(points, 1000 - 10 * i) AS BIGINT) AS total_points,
         CAST(COALESCE(correct_predictions, 0) AS BIGINT) AS correct_predictions, i AS ordinal
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY user_id) AS i FROM users))
"""


@sql("leaderboard_rank", "users")
def _():
    return f""", {ENTRIES}
SELECT *, ROW_NUMBER() OVER (ORDER BY total_points DESC, ordinal) AS position FROM entries
"""


@sql("leaderboard_podium", "users")
def _():
    return f""", {ENTRIES}
SELECT username, total_points FROM entries ORDER BY total_points DESC, ordinal LIMIT 3
"""


@sql("teams_union", "matches")
def _():
    return "SELECT home_team AS team FROM matches UNION SELECT away_team FROM matches ORDER BY team"


@sql("home_only", "raw_matches")
def _():
    return ("SELECT DISTINCT home_team AS team FROM raw_matches WHERE home_team IS NOT NULL "
            "EXCEPT SELECT DISTINCT away_team FROM raw_matches WHERE home_team IS NOT NULL")


@sql("away_only", "raw_matches")
def _():
    return ("SELECT DISTINCT away_team AS team FROM raw_matches WHERE home_team IS NOT NULL "
            "EXCEPT SELECT DISTINCT home_team FROM raw_matches WHERE home_team IS NOT NULL")


@sql("union_seasons", "matches")
def _():
    return f"""SELECT league, match_date, home_team, away_team, home_goals, away_goals, venue, result,
       {SEASON} AS season FROM matches"""


SOURCES = f"""
SELECT 'team' AS kind, name, {SLUG.format(n='name')} AS slug
FROM (SELECT home_team AS name FROM matches UNION SELECT away_team FROM matches)
UNION ALL
SELECT 'stadium', name, {SLUG.format(n='name')} FROM (SELECT DISTINCT venue AS name FROM matches WHERE venue IS NOT NULL AND venue <> '')
"""


@sql("slug_sources", "matches")
def _():
    return SOURCES


@sql("sink_slug_map", "matches")
def _():
    return SOURCES


@sql("scan_slug_map", "matches")
def _():
    return f"""
SELECT slug AS id, name, name AS short_name, '/assets/logos/' || slug || '.svg' AS logo_url
FROM ({SOURCES}) WHERE kind = 'team'
"""


# ------------------------------------------------------------ sources and sinks

NA = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"


@sql("scan_matches_csv", "raw_matches")
def _():
    cols = ["league", "date", "date_text", "home_team", "away_team", "home_goals", "away_goals", "score", "venue",
            "attendance"]
    return "SELECT " + ", ".join(
        f"CASE WHEN CAST({c} AS VARCHAR) IN {NA} THEN NULL ELSE CAST({c} AS VARCHAR) END AS {c}" for c in cols
    ) + " FROM raw_matches"


@sql("sink_csv", "matches")
def _():
    return "SELECT * FROM matches"


@sql("scan_predictions_csv", "predictions")
def _():
    return f"""
SELECT {SEASON} AS season, CAST(match_date AS VARCHAR) AS date, home_team, away_team,
       CAST(GREATEST(0, CAST(round_even(pred_home_goals, 0) AS BIGINT)) AS VARCHAR) AS pred_home_goals,
       CAST(GREATEST(0, CAST(round_even(pred_away_goals, 0) AS BIGINT)) AS VARCHAR) AS pred_away_goals,
       CAST(CAST(pred_result AS DOUBLE) AS VARCHAR) AS pred_result
FROM predictions
"""


@sql("scan_fixtures_csv", "matches")
def _():
    return "SELECT home_team, away_team, CAST(match_date AS VARCHAR) AS date, venue FROM matches WHERE result IS NULL"


SNAP_COLS = "team, played, wins, draws, losses, goals_for, goals_against, points, league, ordinal, season"


@sql("sink_standings", "matches")
def _():
    return STANDINGS + f"SELECT {SNAP_COLS} FROM snap"


@sql("scan_standings_json", "matches")
def _():
    return STANDINGS + f"SELECT {SNAP_COLS} FROM snap WHERE season = (SELECT MAX(season) FROM snap)"


@sql("stream_leaderboard", "users")
def _():
    return f""", {ENTRIES}
SELECT *, ROW_NUMBER() OVER (ORDER BY total_points DESC, ordinal) AS position FROM entries
"""


@sql("stream_standings", "matches")
def _():
    return STANDINGS + """
SELECT team, played, wins, draws, losses, goals_for, goals_against,
       CASE WHEN ordinal = 3 THEN NULL ELSE points END AS points, ordinal, league, season
FROM snap
"""
