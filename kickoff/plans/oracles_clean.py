"""Oracle SQL for cleaning projections, filters and scalar functions."""

from __future__ import annotations

from ..functions import constants as C
from .oracles import MK, sql


def _values(d: dict, a: str, b: str) -> str:
    rows = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in d.items())
    return f"(SELECT * FROM (VALUES {rows}) v({a}, {b}))"


FIXED_ALIASES = _values(C.TEAM_ALIASES, "alias", "canonical")
VENUES = _values(C.VENUE_ALIASES, "alias", "canonical")

CANON = f""",
canon AS (
  SELECT r.league, r.date, r.date_text, r.home_goals, r.away_goals, r.score, r.venue, r.attendance,
         COALESCE(ha.canonical, hf.canonical, r.home_team) AS home_team,
         COALESCE(aa.canonical, af.canonical, r.away_team) AS away_team
  FROM raw_matches r
  LEFT JOIN team_aliases ha ON ha.alias = r.home_team LEFT JOIN {FIXED_ALIASES} hf ON hf.alias = r.home_team
  LEFT JOIN team_aliases aa ON aa.alias = r.away_team LEFT JOIN {FIXED_ALIASES} af ON af.alias = r.away_team)
"""

PARSED = """CAST(TRY_STRPTIME(date, '%Y-%m-%d') AS DATE)"""


def goals(c: str) -> str:
    return (f"CASE WHEN TRY_CAST({c} AS DOUBLE) BETWEEN 0 AND 10 THEN TRY_CAST({c} AS DOUBLE) END")


CLEAN = CANON + f""",
c1 AS (
  SELECT league, date, date_text, TRIM(home_team) AS home_team, TRIM(away_team) AS away_team,
         {PARSED} AS match_date, {goals('home_goals')} AS home_goals, {goals('away_goals')} AS away_goals,
         COALESCE(TRIM(venue), 'Unknown') AS venue0,
         TRY_CAST(replace(replace(attendance, ',', ''), '.', '') AS DOUBLE) AS att
  FROM canon),
clean AS (
  SELECT c1.league, date, date_text, home_team, away_team, match_date, home_goals, away_goals,
         CAST(SIGN(home_goals - away_goals) AS INTEGER) AS result,
         COALESCE(va.canonical, venue0) AS venue,
         CASE WHEN att BETWEEN 0 AND 100000 THEN att END AS attendance,
         YEAR(match_date) AS year, MONTH(match_date) AS month, ISODOW(match_date) - 1 AS day_of_week,
         CASE WHEN MONTH(match_date) >= 8 THEN YEAR(match_date) ELSE YEAR(match_date) - 1 END AS season_year,
         home_goals + away_goals AS total_goals, home_goals - away_goals AS goal_difference
  FROM c1 LEFT JOIN {VENUES} va ON va.alias = c1.venue0
  WHERE home_team IS NOT NULL AND away_team IS NOT NULL AND home_team <> away_team AND match_date IS NOT NULL)
"""

RAW = ("raw_matches", "team_aliases")


@sql("canon_team_names", *RAW)
def _():
    return CANON + "SELECT league, date, home_team, away_team FROM canon"


@sql("trim_team_names", *RAW)
def _():
    return CANON + "SELECT league, date, TRIM(home_team) AS home_team, TRIM(away_team) AS away_team FROM canon"


@sql("parse_match_date", "raw_matches")
def _():
    return f"SELECT league, date, {PARSED} AS match_date FROM raw_matches"


@sql("calendar_parts", "raw_matches")
def _():
    return f"""
SELECT date, YEAR(d) AS year, MONTH(d) AS month, ISODOW(d) - 1 AS day_of_week,
       CASE WHEN ISODOW(d) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend
FROM (SELECT date, {PARSED} AS d FROM raw_matches)
"""


@sql("season_year", "raw_matches")
def _():
    return f"""
SELECT date, CASE WHEN MONTH(d) >= 8 THEN YEAR(d) ELSE YEAR(d) - 1 END AS season_year
FROM (SELECT date, {PARSED} AS d FROM raw_matches)
"""


@sql("clean_scores", "raw_matches")
def _():
    return f"SELECT league, date, {goals('home_goals')} AS home_goals, {goals('away_goals')} AS away_goals FROM raw_matches"


@sql("encode_result", "raw_matches")
def _():
    return f"""
SELECT league, date, home_goals, away_goals, CAST(SIGN(home_goals - away_goals) AS INTEGER) AS result
FROM (SELECT league, date, {goals('home_goals')} AS home_goals, {goals('away_goals')} AS away_goals FROM raw_matches)
"""


@sql("clean_venue", "raw_matches")
def _():
    return f"""
SELECT league, date, COALESCE(va.canonical, v) AS venue
FROM (SELECT league, date, COALESCE(TRIM(venue), 'Unknown') AS v FROM raw_matches) r
LEFT JOIN {VENUES} va ON va.alias = r.v
"""


@sql("clean_attendance", "raw_matches")
def _():
    return """
SELECT league, date, CASE WHEN a BETWEEN 0 AND 100000 THEN a END AS attendance
FROM (SELECT league, date, TRY_CAST(replace(replace(attendance, ',', ''), '.', '') AS DOUBLE) AS a FROM raw_matches)
"""


@sql("derived_goals", *RAW)
def _():
    return CLEAN + f"SELECT {MK}, total_goals, goal_difference FROM clean"


@sql("match_flags", *RAW)
def _():
    return CLEAN + f"""
SELECT {MK}, CASE WHEN total_goals > 3 THEN 1 ELSE 0 END AS high_scoring,
       CASE WHEN total_goals < 2 THEN 1 ELSE 0 END AS low_scoring,
       CASE WHEN ABS(goal_difference) <= 1 THEN 1 ELSE 0 END AS competitive,
       CASE WHEN day_of_week IN (5, 6) THEN 0 ELSE 1 END AS is_midweek
FROM clean
"""


@sql("month_category", *RAW)
def _():
    return CLEAN + f"""
SELECT {MK}, month, CASE WHEN month IN (8, 9, 10) THEN 'early_season' WHEN month IN (11, 12, 1) THEN 'mid_season'
                         WHEN month IN (2, 3, 4, 5) THEN 'late_season' END AS month_category
FROM clean
"""


@sql("drop_columns", *RAW)
def _():
    return CLEAN + """
SELECT league, date, date_text, home_team, away_team, attendance, match_date, total_goals,
       CASE WHEN total_goals > 3 THEN 1 ELSE 0 END AS high_scoring,
       CASE WHEN total_goals < 2 THEN 1 ELSE 0 END AS low_scoring,
       CASE WHEN ABS(goal_difference) <= 1 THEN 1 ELSE 0 END AS competitive,
       CASE WHEN day_of_week IN (5, 6) THEN 0 ELSE 1 END AS is_midweek,
       CASE WHEN month IN (8, 9, 10) THEN 'early_season' WHEN month IN (11, 12, 1) THEN 'mid_season'
            WHEN month IN (2, 3, 4, 5) THEN 'late_season' END AS month_category
FROM clean
"""


@sql("select_existing", "raw_matches")
def _():
    return "SELECT date, home_team, away_team, home_goals, away_goals, score, venue, attendance FROM raw_matches"


@sql("season_label", *RAW)
def _():
    return CLEAN + f"SELECT {MK}, CAST(season_year AS VARCHAR) || '-' || CAST(season_year + 1 AS VARCHAR) AS season FROM clean"


@sql("prediction_format", "predictions")
def _():
    return f"""
SELECT {MK}, h AS predicted_home_goals, a AS predicted_away_goals, CAST(h AS VARCHAR) || '-' || CAST(a AS VARCHAR) AS predicted_score,
       CASE pred_result WHEN 1 THEN 'Home Win' WHEN 0 THEN 'Draw' WHEN -1 THEN 'Away Win' END AS predicted_result
FROM (SELECT *, GREATEST(0, CAST(round_even(pred_home_goals, 0) AS BIGINT)) AS h,
                GREATEST(0, CAST(round_even(pred_away_goals, 0) AS BIGINT)) AS a FROM predictions)
"""


STANDINGS = """,
apps_s AS (
  SELECT league, season_year, home_team AS team, home_goals AS gf, away_goals AS ga, result,
         CASE result WHEN 1 THEN 3 WHEN 0 THEN 1 WHEN -1 THEN 0 END AS points FROM matches
  UNION ALL
  SELECT league, season_year, away_team, away_goals, home_goals, result,
         CASE result WHEN -1 THEN 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END FROM matches),
snap0 AS (
  SELECT league, season_year, team,
         SUM(CASE WHEN result IS NOT NULL THEN 1 ELSE 0 END) AS played,
         SUM(CASE WHEN points = 3 THEN 1 ELSE 0 END) AS wins, SUM(CASE WHEN points = 1 THEN 1 ELSE 0 END) AS draws,
         SUM(CASE WHEN points = 0 THEN 1 ELSE 0 END) AS losses,
         CAST(SUM(CASE WHEN result IS NOT NULL THEN gf END) AS BIGINT) AS goals_for,
         CAST(SUM(CASE WHEN result IS NOT NULL THEN ga END) AS BIGINT) AS goals_against,
         SUM(CASE WHEN result IS NOT NULL THEN points ELSE 0 END) AS points
  FROM apps_s GROUP BY ALL),
snap AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY league, season_year
                               ORDER BY points DESC, COALESCE(goals_for - goals_against, 0) DESC, team) AS ordinal,
         CAST(season_year AS VARCHAR) || '-' || CAST(season_year + 1 AS VARCHAR) AS season
  FROM snap0)
"""


@sql("standings_display", "matches")
def _():
    return STANDINGS + """
SELECT league, season, team, played, wins, draws, losses, goals_for, goals_against, points,
       ordinal AS position, goals_for - goals_against AS gd FROM snap
"""


@sql("drop_invalid_matches", *RAW)
def _():
    return CLEAN + f"SELECT {MK}, home_goals, away_goals, result, venue, attendance FROM clean"


@sql("drop_invalid_report", *RAW)
def _():
    counts = "(SELECT COUNT(*) FROM raw_matches) AS rows_read, (SELECT COUNT(*) FROM clean) AS rows_kept"
    return CLEAN + f"SELECT rows_read, rows_kept, rows_read - rows_kept AS rows_removed FROM (SELECT {counts})"


@sql("filter_scraped_rows", "raw_matches")
def _():
    return """
SELECT league, date, home_team, away_team FROM raw_matches
WHERE home_team IS NOT NULL AND away_team IS NOT NULL AND LENGTH(home_team) >= 2 AND LENGTH(away_team) >= 2
  AND LOWER(home_team) NOT IN ('home', 'team', 'date') AND LOWER(away_team) NOT IN ('away', 'team', 'visitor')
"""


@sql("split_past_future", *RAW)
def _():
    return CLEAN + """
SELECT league, season_year, CASE WHEN home_goals IS NOT NULL AND away_goals IS NOT NULL AND result IS NOT NULL
                                 THEN 'past' ELSE 'future' END AS part, COUNT(*) AS matches
FROM clean GROUP BY ALL
"""


@sql("season_filter", *RAW)
def _():
    return CLEAN + f"""
SELECT {MK}, season FROM (SELECT *, CAST(season_year AS VARCHAR) || '-' || CAST(season_year + 1 AS VARCHAR) AS season FROM clean)
WHERE season = (SELECT MAX(CAST(season_year AS VARCHAR) || '-' || CAST(season_year + 1 AS VARCHAR)) FROM clean)
"""


@sql("find_duplicates", *RAW)
def _():
    return CLEAN + """
SELECT match_date AS date, home_team, away_team, COUNT(*) AS copies, COUNT(*) - 1 AS extra_rows
FROM clean GROUP BY match_date, home_team, away_team HAVING COUNT(*) > 1
"""


@sql("time_split", "matches")
def _():
    return f"""
SELECT {MK}, g, g <= FLOOR(n * 0.8) AS is_train
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY league ORDER BY match_date, home_team, away_team) AS g,
             COUNT(*) OVER (PARTITION BY league) AS n FROM matches
      WHERE home_goals IS NOT NULL AND away_goals IS NOT NULL AND result IS NOT NULL)
"""


# ------------------------------------------------------------ scalar functions

def _runs(c: str) -> str:
    return f"regexp_extract_all(COALESCE({c}, ''), '(\\d+)', 1)"


@sql("parse_score", "raw_matches")
def _():
    r = _runs("score")
    return f"""
SELECT league, date, score,
       CASE WHEN len({r}) >= 2 THEN TRY_CAST({r}[1] AS INTEGER) END AS home_goals,
       CASE WHEN len({r}) >= 2 THEN TRY_CAST({r}[2] AS INTEGER) END AS away_goals
FROM raw_matches
"""


def _date_text(c: str) -> str:
    x = f"LOWER(TRIM({c}))"
    for es, en in C.SPANISH_MONTHS:
        if es != en:
            x = f"REPLACE({x}, '{es}', '{en}')"
    fmts = ["%Y-%m-%d", "%d/%m/%Y", "%d %b %Y", "%b %d, %Y", "%d %B %Y", "%B %d, %Y"]
    parsed = ", ".join(f"strftime(TRY_STRPTIME(x, '{f}'), '%Y-%m-%d')" for f in fmts)
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN '' ELSE COALESCE({parsed}, x) END", x


@sql("parse_date_text", "raw_matches")
def _():
    expr, x = _date_text("date_text")
    return f"SELECT league, date_text, {expr} AS parsed FROM (SELECT league, date_text, {x} AS x FROM raw_matches)"


@sql("result_label", "raw_matches")
def _():
    r = _runs("score")
    return f"""
SELECT league, date, score,
       CASE WHEN h IS NULL OR a IS NULL THEN 'Unknown' WHEN h > a THEN 'Home Win' WHEN a > h THEN 'Away Win' ELSE 'Draw' END AS result_label
FROM (SELECT *, CASE WHEN len({r}) >= 2 THEN TRY_CAST({r}[1] AS INTEGER) END AS h,
                CASE WHEN len({r}) >= 2 THEN TRY_CAST({r}[2] AS INTEGER) END AS a FROM raw_matches)
"""


@sql("result_to_name", "matches")
def _():
    return f"""
SELECT {MK}, result, CASE result WHEN 1 THEN 'Home Win' WHEN 0 THEN 'Draw' WHEN -1 THEN 'Away Win' END AS result_name
FROM matches
"""


SLUG = "regexp_replace(LOWER(REPLACE({n}, ' ', '-')), '[^\\p{{L}}\\p{{N}}-]', '', 'g')"


@sql("slugify", "matches")
def _():
    return f"""
SELECT name, {SLUG.format(n='name')} AS slug
FROM (SELECT home_team AS name FROM matches UNION SELECT away_team FROM matches UNION SELECT venue FROM matches)
"""


@sql("initials", "matches")
def _():
    return f"""
SELECT team, slug, UPPER(CASE WHEN len(w) = 0 THEN 'X' WHEN len(w) = 1 THEN SUBSTR(w[1], 1, 2)
                              ELSE SUBSTR(w[1], 1, 1) || SUBSTR(w[2], 1, 1) END) AS initials
FROM (SELECT team, slug, list_filter(string_split(REPLACE(slug, '-', ' '), ' '), lambda s: s <> '') AS w
      FROM (SELECT team, {SLUG.format(n='team')} AS slug
            FROM (SELECT home_team AS team FROM matches UNION SELECT away_team FROM matches)))
"""


@sql("palette_index", "matches")
def _():
    return """
SELECT team, ordinal,
       ['#e63946', '#457b9d', '#2a9d8f', '#ffb703', '#8d99ae', '#6a4c93'][ordinal % 6 + 1] AS colour
FROM (SELECT team, ROW_NUMBER() OVER (ORDER BY f) - 1 AS ordinal
      FROM (SELECT team, MIN({'d': match_date, 'h': home_team, 'a': away_team, 's': side}) AS f
            FROM (SELECT match_date, home_team, away_team, 0 AS side, home_team AS team FROM matches
                  UNION ALL SELECT match_date, home_team, away_team, 1, away_team FROM matches)
            GROUP BY team))
"""
