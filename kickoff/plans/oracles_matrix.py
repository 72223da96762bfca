"""Oracle SQL for the full feature matrix: the per-family oracles joined on the
match key, then nulls filled with column medians (as the Spark query does); and the
same features of appended requests."""

from __future__ import annotations

from ..fixtures import MATCHES_SQL, duck
from ..operators.features import FEATURE_COLUMNS
from .oracles import ELO, MK, ORACLES, sql

USING = "USING (league, match_date, home_team, away_team)"


def _joined() -> str:
    """All families beside the matches, unfilled."""
    def sub(name: str) -> str:
        return "(" + ORACLES[name] + ")"
    elo = ("(" + ORACLES["elo_ratings"].split(ELO, 1)[0] + ELO
           + f"SELECT {MK}, home_elo, away_elo, home_elo - away_elo AS elo_difference FROM elo_out)")
    return f"""
SELECT b.league, b.match_date, b.home_team, b.away_team, b.season_year, b.home_goals, b.away_goals, b.result,
       MONTH(b.match_date) AS month, ISODOW(b.match_date) - 1 AS day_of_week,
       CASE WHEN ISODOW(b.match_date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
       le.home_team_encoded, le.away_team_encoded, le.venue_encoded,
       el.home_elo, el.away_elo, el.elo_difference,
       ap.* EXCLUDE (league, match_date, home_team, away_team),
       h.* EXCLUDE (league, match_date, home_team, away_team),
       v.* EXCLUDE (league, match_date, home_team, away_team),
       lp.* EXCLUDE (league, match_date, home_team, away_team),
       sp.season_progress
FROM matches b
JOIN {sub("label_encode")} le {USING}
JOIN {elo} el {USING}
JOIN {sub("join_home_away_features")} ap {USING}
JOIN {sub("head_to_head")} h {USING}
JOIN {sub("venue_features")} v {USING}
JOIN {sub("league_position")} lp {USING}
JOIN {sub("season_progress")} sp {USING}
"""


@sql("feature_matrix", "matches")
def _():
    feats = ", ".join(
        f"ROUND(CAST(COALESCE({c}, (SELECT MEDIAN({c}) FROM j)) AS DOUBLE), 6) AS {c}" for c in FEATURE_COLUMNS)
    return f""", j AS ({_joined()})
SELECT {MK}, season_year, {feats}, home_goals, away_goals, result FROM j
"""


ORACLES["feature_matrix"] = ORACLES["feature_matrix"].replace("WITH raw_matches", "WITH RECURSIVE raw_matches", 1)

_PLAIN = "matches AS (" + duck(MATCHES_SQL, raw_matches="raw_matches") + ")"
_APPENDED = "history AS (" + duck(MATCHES_SQL, raw_matches="raw_matches") + """),
last AS (SELECT league, MAX(match_date) AS d, MAX(season_year) AS s FROM history GROUP BY league),
reqs AS (
  SELECT CAST(h.league AS VARCHAR) || '|' || CAST(match_date AS VARCHAR) || '|' || home_team || '|' || away_team AS request_id, h.league,
         CASE WHEN DAY(match_date) % 3 > 0 THEN CAST(match_date + INTERVAL 1 DAY AS DATE) END AS asked,
         CAST(CASE WHEN DAY(match_date) % 3 > 0 THEN match_date + INTERVAL 1 DAY ELSE d + INTERVAL 1 DAY END AS DATE) AS match_date, s,
         away_team AS home_team, home_team AS away_team
  FROM history h JOIN last USING (league) WHERE result IS NULL),
matches AS (
  SELECT * FROM history
  UNION ALL BY NAME
  SELECT DISTINCT league, match_date, home_team, away_team, 'Unknown' AS venue,
         CASE WHEN asked IS NULL THEN s WHEN MONTH(match_date) >= 8 THEN YEAR(match_date) ELSE YEAR(match_date) - 1 END AS season_year
  FROM reqs ANTI JOIN history USING (league, match_date, home_team, away_team))"""


@sql("append_fixture", "matches")
def _():
    feats = ", ".join(f"ROUND(CAST({'CASE WHEN asked IS NOT NULL THEN ' + c + ' END' if c in ('month', 'day_of_week', 'is_weekend') else c} AS DOUBLE), 6) AS {c}" for c in FEATURE_COLUMNS)
    return f""", j AS ({_joined()})
SELECT request_id, league, asked AS match_date, home_team, away_team,
       CAST(CASE WHEN asked IS NULL THEN s WHEN MONTH(asked) >= 8 THEN YEAR(asked) ELSE YEAR(asked) - 1 END AS INTEGER) AS season_year, {feats}
FROM reqs JOIN j {USING}
"""


ORACLES["append_fixture"] = ORACLES["append_fixture"].replace("WITH raw_matches", "WITH RECURSIVE raw_matches", 1).replace(_PLAIN, _APPENDED)

# the stream gets the seasons in order, so its ratings are those of one run over all matches
ORACLES["stream_elo"] = ORACLES["elo_ratings"]
