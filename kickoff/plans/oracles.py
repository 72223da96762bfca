"""Oracle SQL (DuckDB) for the registered queries.

Written the naive way, independent of the Spark plans: "strictly earlier"
is a self-join on ``date <`` and "the last N" is a top-N aggregate over it.
The fixture derivation is prefixed as CTEs so DuckDB starts from the same rows.
Doubles are rounded to six places, as the Spark side does.
"""

from __future__ import annotations

from ..fixtures import oracle_with

ORACLES: dict[str, str] = {}


def sql(name: str, *ctes: str):
    def deco(fn):
        body = fn()
        ORACLES[name] = (oracle_with(*ctes) + body) if ctes else body
        return fn
    return deco


MK = "league, match_date, home_team, away_team"

# appearances: one row per (match, side)
APPS = """,
apps AS (
  SELECT league, match_date, home_team, away_team, TRUE AS is_home, home_team AS team, away_team AS opponent,
         home_goals AS gf, away_goals AS ga, result,
         CASE result WHEN 1 THEN 3 WHEN 0 THEN 1 WHEN -1 THEN 0 END AS points FROM matches
  UNION ALL
  SELECT league, match_date, home_team, away_team, FALSE, away_team, home_team, away_goals, home_goals, result,
         CASE result WHEN -1 THEN 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END FROM matches)
"""

ORDER = "{'d': p.match_date, 'h': p.home_team, 'a': p.away_team}"


def prev_team(n: int, fields: str) -> str:
    """Newest-first list of the team's last n matches on strictly earlier dates."""
    return f""",
prev AS (
  SELECT a.league, a.match_date, a.home_team, a.away_team, a.is_home,
         max_by({{{fields}}}, {ORDER}, {n}) FILTER (WHERE p.team IS NOT NULL) AS l,
         COUNT(p.team) AS nb
  FROM apps a LEFT JOIN apps p ON p.league = a.league AND p.team = a.team AND p.match_date < a.match_date
  GROUP BY ALL)
"""


def pivot(cols: list[str], src: str = "f") -> str:
    sel = ", ".join(f"MAX(CASE WHEN is_home THEN {c} END) AS home_{c}, "
                    f"MAX(CASE WHEN NOT is_home THEN {c} END) AS away_{c}" for c in cols)
    return f"SELECT {MK}, {sel} FROM {src} GROUP BY {MK}"


def r6(expr: str, alias: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6) AS {alias}"


# ------------------------------------------------------------ league table

@sql("league_table", "matches")
def _():
    return APPS + """,
t AS (
  SELECT league, season_year, team,
         SUM(CASE WHEN result IS NOT NULL THEN points ELSE 0 END) AS points,
         SUM(CASE WHEN result IS NOT NULL THEN 1 ELSE 0 END) AS played,
         SUM(CASE WHEN result IS NOT NULL AND gf IS NOT NULL AND ga IS NOT NULL THEN gf - ga ELSE 0 END) AS gd
  FROM (SELECT a.*, m.season_year FROM apps a JOIN matches m USING (league, match_date, home_team, away_team))
  GROUP BY league, season_year, team)
SELECT league, season_year, team, CAST(points AS BIGINT) AS points, CAST(played AS BIGINT) AS played,
       ROUND(gd, 6) AS gd, ROUND(points / GREATEST(played, 1), 6) AS points_per_game,
       ROW_NUMBER() OVER (PARTITION BY league, season_year ORDER BY points DESC, gd DESC, team) AS position
FROM t
"""


@sql("team_unpivot", "matches")
def _():
    return APPS + f"SELECT {MK}, is_home, team, opponent, gf, ga, points FROM apps"


@sql("asof_last_n", "matches")
def _():
    return APPS + prev_team(5, "'points': p.points, 'd': p.match_date") + f"""
SELECT {MK}, is_home, CAST(COALESCE(len(l), 0) AS BIGINT) AS n_prev,
       CAST(COALESCE(list_sum(list_transform(l, lambda x: COALESCE(x.points, 0))), 0) AS BIGINT) AS prev_points,
       l[len(l)].d AS oldest_date, nb
FROM prev
"""


def _form_sql(kind: str) -> str:
    cols = []
    for w in (3, 5, 10):
        s = f"COALESCE(l[1:{w}], [])"
        n = f"GREATEST(len({s}), 1)"
        if kind == "points":
            num = f"COALESCE(list_sum(list_transform({s}, lambda x: COALESCE(x.points, 0))), 0)"
            cols.append(r6(f"{num} / (3.0 * {n})", f"form_{w}"))
        else:
            fld = "gf" if kind == "goals" else "ga"
            num = (f"COALESCE(list_sum(list_transform({s}, lambda x: CASE WHEN x.gf IS NOT NULL AND x.ga IS NOT NULL "
                   f"THEN x.{fld} ELSE 0 END)), 0)")
            cols.append(r6(f"{num} / {n}", f"{kind}_form_{w}"))
    names = [c.rsplit(" AS ", 1)[1] for c in cols]
    return (APPS + prev_team(10, "'points': p.points, 'gf': p.gf, 'ga': p.ga")
            + f", f AS (SELECT {MK}, is_home, {', '.join(cols)} FROM prev)\n" + pivot(names))


@sql("form_points_w", "matches")
def _():
    return _form_sql("points")


@sql("form_goals_w", "matches")
def _():
    return _form_sql("goals")


@sql("form_conceded_w", "matches")
def _():
    return _form_sql("conceded")


# ------------------------------------------------------------ head to head

PAIR_PREV = """,
pp AS (
  SELECT m.league, m.match_date, m.home_team, m.away_team,
         max_by({'home_team': p.home_team, 'home_goals': p.home_goals, 'away_goals': p.away_goals,
                 'result': p.result, 'd': p.match_date},
                {'d': p.match_date, 'h': p.home_team, 'a': p.away_team}, 10)
           FILTER (WHERE p.home_team IS NOT NULL) AS l,
         COUNT(p.home_team) AS nb
  FROM matches m LEFT JOIN matches p
    ON p.league = m.league AND p.match_date < m.match_date
   AND ((p.home_team = m.home_team AND p.away_team = m.away_team)
     OR (p.home_team = m.away_team AND p.away_team = m.home_team))
  GROUP BY ALL)
"""


@sql("head_to_head", "matches")
def _():
    return PAIR_PREV + f"""
, s AS (
  SELECT {MK}, COALESCE(len(l), 0) AS n,
    COALESCE(list_sum(list_transform(l, lambda x: CASE WHEN x.result IS NULL THEN 0
         WHEN (x.home_team = home_team AND x.result = 1) OR (x.home_team <> home_team AND x.result = -1) THEN 1 ELSE 0 END)), 0) AS hw,
    COALESCE(list_sum(list_transform(l, lambda x: CASE WHEN x.result IS NULL THEN 0
         WHEN (x.home_team = home_team AND x.result = -1) OR (x.home_team <> home_team AND x.result = 1) THEN 1 ELSE 0 END)), 0) AS aw,
    COALESCE(list_sum(list_transform(l, lambda x: CASE WHEN x.result = 0 THEN 1 ELSE 0 END)), 0) AS dr,
    COALESCE(list_sum(list_transform(l, lambda x: CASE WHEN x.result IS NULL THEN 0.0
         WHEN x.home_team = home_team THEN x.home_goals ELSE x.away_goals END)), 0) AS hg,
    COALESCE(list_sum(list_transform(l, lambda x: CASE WHEN x.result IS NULL THEN 0.0
         WHEN x.home_team = home_team THEN x.away_goals ELSE x.home_goals END)), 0) AS ag
  FROM pp)
SELECT {MK},
  {r6("CASE WHEN n = 0 THEN 0.33 ELSE hw / n END", "h2h_home_wins")},
  {r6("CASE WHEN n = 0 THEN 0.33 ELSE aw / n END", "h2h_away_wins")},
  {r6("CASE WHEN n = 0 THEN 0.33 ELSE dr / n END", "h2h_draws")},
  {r6("CASE WHEN n = 0 THEN 1.5 ELSE hg / n END", "h2h_home_goals_avg")},
  {r6("CASE WHEN n = 0 THEN 1.5 ELSE ag / n END", "h2h_away_goals_avg")},
  {r6("CASE WHEN n = 0 THEN 3.0 ELSE (hg + ag) / n END", "h2h_total_goals_avg")},
  CAST(n AS BIGINT) AS h2h_matches_count
FROM s
"""


@sql("asof_pair_last_n", "matches")
def _():
    return PAIR_PREV + f"""
SELECT {MK}, CAST(COALESCE(len(l), 0) AS BIGINT) AS n_meetings, l[len(l)].d AS oldest_meeting,
       nb AS all_meetings FROM pp
"""


# ------------------------------------------------------------ venue

@sql("venue_features", "matches")
def _():
    return f"""
SELECT m.league, m.match_date, m.home_team, m.away_team,
  ROUND(COALESCE((SELECT SUM(CASE p.result WHEN 1 THEN 3 WHEN 0 THEN 1 ELSE 0 END) / (3.0 * COUNT(*))
            FROM matches p WHERE p.league = m.league AND p.venue = m.venue AND p.home_team = m.home_team
              AND p.match_date < m.match_date HAVING COUNT(*) > 0), 0.5), 6) AS home_venue_advantage,
  ROUND(COALESCE((SELECT SUM(CASE p.result WHEN -1 THEN 3 WHEN 0 THEN 1 ELSE 0 END) / (3.0 * COUNT(*))
            FROM matches p WHERE p.league = m.league AND p.venue = m.venue AND p.away_team = m.away_team
              AND p.match_date < m.match_date HAVING COUNT(*) > 0), 0.3), 6) AS away_venue_performance
FROM matches m
"""


@sql("asof_venue", "matches")
def _():
    return f"""
SELECT m.league, m.match_date, m.home_team, m.away_team, m.venue,
  (SELECT COUNT(*) FROM matches p WHERE p.league = m.league AND p.venue = m.venue
     AND p.home_team = m.home_team AND p.match_date < m.match_date) AS home_at_venue,
  (SELECT COUNT(*) FROM matches p WHERE p.league = m.league AND p.venue = m.venue
     AND p.away_team = m.away_team AND p.match_date < m.match_date) AS away_at_venue
FROM matches m
"""


# ------------------------------------------------------------ momentum & streaks

LEAGUE_ORD = """,
lo AS (
  SELECT m.*, ROW_NUMBER() OVER (PARTITION BY league ORDER BY match_date, home_team, away_team) AS g,
         (SELECT COUNT(*) FROM matches q WHERE q.league = m.league AND q.match_date < m.match_date) AS gb
  FROM matches m)
"""

RECENT = """,
recent AS (
  SELECT a.league, a.match_date, a.home_team, a.away_team, a.is_home, c.g AS g, c.gb AS gb,
         max_by({'points': p.points}, {'d': p.match_date, 'h': p.home_team, 'a': p.away_team}, 15)
           FILTER (WHERE p.team IS NOT NULL AND q.g > c.gb - 50) AS l
  FROM apps a
  JOIN lo c ON c.league = a.league AND c.match_date = a.match_date AND c.home_team = a.home_team AND c.away_team = a.away_team
  LEFT JOIN apps p ON p.league = a.league AND p.team = a.team AND p.match_date < a.match_date
  LEFT JOIN lo q ON q.league = p.league AND q.match_date = p.match_date AND q.home_team = p.home_team AND q.away_team = p.away_team
  GROUP BY ALL)
"""


def _streak_sql(kind: str) -> str:
    if kind == "win":
        s, pred = "COALESCE(l[1:10], [])", "COALESCE(x.points = 3, false)"
    else:
        s, pred = "COALESCE(l[1:15], [])", "COALESCE(x.points >= 1, false)"
    pos = f"list_position(list_transform({s}, lambda x: {pred}), false)"
    return (APPS + LEAGUE_ORD + RECENT
            + f", f AS (SELECT {MK}, is_home, CAST(COALESCE({pos} - 1, len({s})) AS BIGINT) AS {kind}_streak FROM recent)\n"
            + pivot([f"{kind}_streak"]))


@sql("win_streak", "matches")
def _():
    return _streak_sql("win")


@sql("unbeaten_streak", "matches")
def _():
    return _streak_sql("unbeaten")


@sql("momentum", "matches")
def _():
    s = "COALESCE(l[1:8], [])"
    pl = f"list_filter({s}, lambda x: x.points IS NOT NULL)"
    num = f"list_sum(list_transform({pl}, lambda x, i: x.points / 3.0 * pow(0.9, i - 1)))"
    den = f"list_sum(list_transform({pl}, lambda x, i: pow(0.9, i - 1)))"
    expr = f"CASE WHEN len({s}) = 0 THEN 0.5 WHEN COALESCE({den}, 0) > 0 THEN {num} / {den} ELSE 0.5 END"
    return (APPS + LEAGUE_ORD + RECENT + f", f AS (SELECT {MK}, is_home, {r6(expr, 'momentum')} FROM recent)\n"
            + pivot(["momentum"]))


@sql("global_last_50", "matches")
def _():
    return APPS + LEAGUE_ORD + f"""
SELECT a.league, a.match_date, a.home_team, a.away_team, a.is_home, MIN(c.g) AS g, MIN(c.gb) AS gb, COUNT(q.g) AS recent_count
FROM apps a
JOIN lo c ON c.league = a.league AND c.match_date = a.match_date AND c.home_team = a.home_team AND c.away_team = a.away_team
LEFT JOIN lo q ON q.league = a.league AND (q.home_team = a.team OR q.away_team = a.team) AND q.g <= c.gb AND q.g > c.gb - 50
GROUP BY ALL
"""


# ------------------------------------------------------------ as-of league table

ASOF_TABLE = APPS + """,
snap AS (SELECT DISTINCT league, season_year, match_date AS as_of FROM matches),
sa AS (SELECT a.*, m.season_year FROM apps a JOIN matches m USING (league, match_date, home_team, away_team)),
tbl AS (
  SELECT s.league, s.season_year, s.as_of, a.team,
         SUM(CASE WHEN a.result IS NOT NULL THEN a.points ELSE 0 END) AS points,
         SUM(CASE WHEN a.result IS NOT NULL THEN 1 ELSE 0 END) AS played,
         SUM(CASE WHEN a.result IS NOT NULL AND a.gf IS NOT NULL AND a.ga IS NOT NULL THEN a.gf - a.ga ELSE 0 END) AS gd
  FROM snap s JOIN sa a ON a.league = s.league AND a.season_year = s.season_year AND a.match_date < s.as_of
  GROUP BY ALL),
ranked AS (
  SELECT *, points / GREATEST(played, 1) AS points_per_game,
         ROW_NUMBER() OVER (PARTITION BY league, season_year, as_of ORDER BY points DESC, gd DESC, team) AS position
  FROM tbl)
"""


@sql("asof_season_table", "matches")
def _():
    return ASOF_TABLE + """
SELECT league, season_year, as_of, team, CAST(points AS BIGINT) AS points, CAST(played AS BIGINT) AS played,
       ROUND(gd, 6) AS gd, ROUND(points_per_game, 6) AS points_per_game, position FROM ranked
"""


# The same table from running sums: a team's last state before each date of the season.
ASOF_RUNNING = ASOF_TABLE.replace(ASOF_TABLE[ASOF_TABLE.index("tbl AS ("):ASOF_TABLE.index("ranked AS (")], """days AS (
  SELECT league, season_year, team, match_date,
         SUM(CASE WHEN result IS NOT NULL THEN points ELSE 0 END) AS points, SUM(CASE WHEN result IS NOT NULL THEN 1 ELSE 0 END) AS played,
         SUM(CASE WHEN result IS NOT NULL AND gf IS NOT NULL AND ga IS NOT NULL THEN gf - ga ELSE 0 END) AS gd
  FROM sa GROUP BY ALL),
states AS (
  SELECT league, season_year, team, match_date, SUM(points) OVER w AS points, SUM(played) OVER w AS played, SUM(gd) OVER w AS gd
  FROM days WINDOW w AS (PARTITION BY league, season_year, team ORDER BY match_date)),
wanted AS (SELECT s.*, t.team FROM snap s JOIN (SELECT DISTINCT league, season_year, team FROM days) t USING (league, season_year)),
tbl AS (
  SELECT q.league, q.season_year, q.as_of, q.team, x.points, x.played, x.gd
  FROM wanted q ASOF JOIN states x ON x.league = q.league AND x.season_year = q.season_year AND x.team = q.team AND q.as_of > x.match_date),
""")


@sql("league_position", "matches")
def _():
    return ASOF_RUNNING + f"""
SELECT m.league, m.match_date, m.home_team, m.away_team,
       CAST(COALESCE(h.position, 10) AS BIGINT) AS home_league_position,
       CAST(COALESCE(a.position, 10) AS BIGINT) AS away_league_position,
       CAST(COALESCE(h.position, 10) - COALESCE(a.position, 10) AS BIGINT) AS position_difference,
       ROUND(COALESCE(h.points_per_game, 1.5), 6) AS home_points_per_game,
       ROUND(COALESCE(a.points_per_game, 1.5), 6) AS away_points_per_game
FROM matches m
LEFT JOIN ranked h ON h.league = m.league AND h.season_year = m.season_year AND h.as_of = m.match_date AND h.team = m.home_team
LEFT JOIN ranked a ON a.league = m.league AND a.season_year = m.season_year AND a.as_of = m.match_date AND a.team = m.away_team
"""


@sql("season_progress", "matches")
def _():
    return f"""
SELECT {MK}, ROUND((ROW_NUMBER() OVER (PARTITION BY league, season_year ORDER BY match_date, home_team, away_team) - 1)
                   / COUNT(*) OVER (PARTITION BY league, season_year), 6) AS season_progress
FROM matches
"""


@sql("label_encode", "matches")
def _():
    return f"""
SELECT {MK},
  (SELECT COUNT(DISTINCT q.home_team) FROM matches q WHERE q.home_team < m.home_team) AS home_team_encoded,
  (SELECT COUNT(DISTINCT q.away_team) FROM matches q WHERE q.away_team < m.away_team) AS away_team_encoded,
  (SELECT COUNT(DISTINCT COALESCE(q.venue, 'Unknown')) FROM matches q
     WHERE COALESCE(q.venue, 'Unknown') < COALESCE(m.venue, 'Unknown')) AS venue_encoded
FROM matches m
"""


@sql("join_home_away_features", "matches")
def _():
    cols = []
    for w in (3, 5, 10):
        s = f"COALESCE(prev.l[1:{w}], [])"
        n = f"GREATEST(len({s}), 1)"
        cols.append(r6(f"COALESCE(list_sum(list_transform({s}, lambda x: COALESCE(x.points, 0))), 0) / (3.0 * {n})",
                       f"form_{w}"))
        for kind, fld in (("goals", "gf"), ("conceded", "ga")):
            num = (f"COALESCE(list_sum(list_transform({s}, lambda x: CASE WHEN x.gf IS NOT NULL AND x.ga IS NOT NULL "
                   f"THEN x.{fld} ELSE 0 END)), 0)")
            cols.append(r6(f"{num} / {n}", f"{kind}_form_{w}"))
    names = [c.rsplit(" AS ", 1)[1] for c in cols]
    s8 = "COALESCE(r.l[1:8], [])"
    pl = f"list_filter({s8}, lambda x: x.points IS NOT NULL)"
    num = f"list_sum(list_transform({pl}, lambda x, i: x.points / 3.0 * pow(0.9, i - 1)))"
    den = f"list_sum(list_transform({pl}, lambda x, i: pow(0.9, i - 1)))"
    mom = f"CASE WHEN len({s8}) = 0 THEN 0.5 WHEN COALESCE({den}, 0) > 0 THEN {num} / {den} ELSE 0.5 END"
    win = "COALESCE(r.l[1:10], [])"
    unb = "COALESCE(r.l[1:15], [])"
    streaks = (f"CAST(COALESCE(list_position(list_transform({win}, lambda x: COALESCE(x.points = 3, false)), false) - 1, len({win})) AS BIGINT) AS win_streak, "
               f"CAST(COALESCE(list_position(list_transform({unb}, lambda x: COALESCE(x.points >= 1, false)), false) - 1, len({unb})) AS BIGINT) AS unbeaten_streak, "
               + r6(mom, "momentum"))
    return (APPS + prev_team(10, "'points': p.points, 'gf': p.gf, 'ga': p.ga") + LEAGUE_ORD + RECENT
            + f", f AS (SELECT prev.league, prev.match_date, prev.home_team, prev.away_team, prev.is_home, "
            + ", ".join(cols) + ", " + streaks
            + " FROM prev JOIN recent r USING (league, match_date, home_team, away_team, is_home))\n"
            + pivot(names + ["win_streak", "unbeaten_streak", "momentum"]))


# ------------------------------------------------------------ Elo (ordered fold as a recursive CTE)

ELO = """,
ord AS (SELECT league, match_date, home_team, away_team, result,
               ROW_NUMBER() OVER (PARTITION BY league ORDER BY match_date, home_team, away_team) AS k FROM matches),
elo AS (
  SELECT league, 0::BIGINT AS k, MAP {}::MAP(VARCHAR, DOUBLE) AS r, NULL::DATE AS match_date, NULL::VARCHAR AS home_team,
         NULL::VARCHAR AS away_team, NULL::DOUBLE AS home_elo, NULL::DOUBLE AS away_elo
  FROM (SELECT DISTINCT league FROM matches)
  UNION ALL
  SELECT league, k, CASE WHEN result IS NULL THEN r ELSE map_concat(r, MAP([home_team, away_team],
             [rh + 32 * (sh - eh), ra + 32 * ((1 - sh) - (1 - eh))])) END,
         match_date, home_team, away_team, rh, ra
  FROM (SELECT o.league, o.k, e.r, o.match_date, o.home_team, o.away_team, o.result,
               COALESCE(e.r[o.home_team], 1500.0) AS rh, COALESCE(e.r[o.away_team], 1500.0) AS ra,
               CASE o.result WHEN 1 THEN 1.0 WHEN -1 THEN 0.0 ELSE 0.5 END AS sh,
               1 / (1 + POW(10, (COALESCE(e.r[o.away_team], 1500.0) - COALESCE(e.r[o.home_team], 1500.0)) / 400)) AS eh
        FROM elo e JOIN ord o ON o.league = e.league AND o.k = e.k + 1)),
elo_out AS (SELECT league, match_date, home_team, away_team, home_elo, away_elo FROM elo WHERE k > 0)
"""


def _recursive(body: str) -> str:
    return body.replace("WITH raw_matches", "WITH RECURSIVE raw_matches", 1)


@sql("elo_ratings", "matches")
def _():
    return ELO + f"SELECT {MK}, ROUND(home_elo, 6) AS home_elo, ROUND(away_elo, 6) AS away_elo FROM elo_out"


@sql("elo_difference", "matches")
def _():
    return ELO + f"SELECT {MK}, ROUND(home_elo - away_elo, 6) AS elo_difference FROM elo_out"


@sql("elo_expected", "matches")
def _():
    return ELO + f"SELECT {MK}, ROUND(1 / (1 + POW(10, (away_elo - home_elo) / 400)), 6) AS expected_home FROM elo_out"


for _name in ("elo_ratings", "elo_difference", "elo_expected"):
    ORACLES[_name] = _recursive(ORACLES[_name])
