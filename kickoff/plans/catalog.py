"""The query catalogue: every registered query, grouped as in the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import history as H
from ..operators.history import MATCH_KEY
from .registry import query

APP_KEY = MATCH_KEY + ["is_home"]


# ============================================================ 2.5 / 2.6 as-of features

@query("league_table")
def q_league_table(t):
    """Final standings per (league, season): points, played, gd, ppg, position."""
    return FE.league_table(t.matches()).select(
        "league", "season_year", "team", "points", "played", "gd", "points_per_game", "position")


@query("team_unpivot")
def q_team_unpivot(t):
    """Home and away view of every match, one row per team appearance."""
    return H.team_unpivot(t.matches()).select(*APP_KEY, "team", "opponent", "gf", "ga", "points")


@query("asof_last_n")
def q_asof_last_n(t):
    """The team's last 5 matches on strictly earlier dates: count, points, oldest date."""
    apps = H.with_team_history(H.team_unpivot(t.matches()).withColumn("d", F.col("match_date")),
                               ["points", "d"], 5)
    h = F.col("hist")
    return apps.select(*APP_KEY, F.size(h).cast("bigint").alias("n_prev"),
                       F.aggregate(h, F.lit(0), lambda a, x: a + F.coalesce(x.points, F.lit(0)))
                        .cast("bigint").alias("prev_points"),
                       F.try_element_at(h, F.lit(1)).d.alias("oldest_date"), "nb")


@query("form_points_w")
def q_form_points(t):
    """Points share over the last 3 / 5 / 10 earlier matches, both sides."""
    return FE.form_features(t.matches()).select(
        *MATCH_KEY, *[f"{s}_form_{w}" for w in (3, 5, 10) for s in ("home", "away")])


@query("form_goals_w")
def q_form_goals(t):
    """Goals scored per match over the last 3 / 5 / 10 earlier matches."""
    return FE.form_features(t.matches()).select(
        *MATCH_KEY, *[f"{s}_goals_form_{w}" for w in (3, 5, 10) for s in ("home", "away")])


@query("form_conceded_w")
def q_form_conceded(t):
    """Goals conceded per match over the last 3 / 5 / 10 earlier matches."""
    return FE.form_features(t.matches()).select(
        *MATCH_KEY, *[f"{s}_conceded_form_{w}" for w in (3, 5, 10) for s in ("home", "away")])


@query("head_to_head")
def q_head_to_head(t):
    """Seven head-to-head outputs over the pair's last 10 earlier meetings."""
    return FE.head_to_head(t.matches())


@query("asof_pair_last_n")
def q_asof_pair_last_n(t):
    """The pair's last 10 earlier meetings (either venue order): count and oldest date."""
    m = (t.matches().withColumn("pair_lo", F.least("home_team", "away_team"))
         .withColumn("pair_hi", F.greatest("home_team", "away_team"))
         .withColumn("d", F.col("match_date")))
    m = H.with_team_history(m, ["d"], 10, part=["league", "pair_lo", "pair_hi"])
    return m.select(*MATCH_KEY, F.size("hist").cast("bigint").alias("n_meetings"),
                    F.try_element_at("hist", F.lit(1)).d.alias("oldest_meeting"), F.col("nb").alias("all_meetings"))


@query("venue_features")
def q_venue_features(t):
    """Home team's points share at the venue; away team's at the venue."""
    return FE.venue_features(t.matches())


@query("asof_venue")
def q_asof_venue(t):
    """Counts of earlier matches at the same venue with the same home / away team."""
    m = t.matches().withColumn("_day", H.day_number())
    from pyspark.sql import Window
    wh = Window.partitionBy("league", "venue", "home_team").orderBy("_day").rangeBetween(
        Window.unboundedPreceding, -1)
    wa = Window.partitionBy("league", "venue", "away_team").orderBy("_day").rangeBetween(
        Window.unboundedPreceding, -1)
    return m.select(*MATCH_KEY, "venue", F.count(F.lit(1)).over(wh).alias("home_at_venue"),
                    F.count(F.lit(1)).over(wa).alias("away_at_venue"))


@query("win_streak")
def q_win_streak(t):
    """Leading wins (newest first, unplayed stops) within the league's last 50 matches."""
    return FE.momentum_features(t.matches()).select(*MATCH_KEY, "home_win_streak", "away_win_streak")


@query("unbeaten_streak")
def q_unbeaten_streak(t):
    """Leading not-lost matches (≤15, unplayed stops) within the league's last 50."""
    return FE.momentum_features(t.matches()).select(
        *MATCH_KEY, "home_unbeaten_streak", "away_unbeaten_streak")


@query("momentum")
def q_momentum(t):
    """Decayed points share over ≤8 recent matches (unplayed skipped)."""
    return FE.momentum_features(t.matches()).select(*MATCH_KEY, "home_momentum", "away_momentum")


@query("global_last_50")
def q_global_last_50(t):
    """League ordinal, earlier-date count, and how many of the team's
    matches are among the league's last 50 matches before the date."""
    return FE.recent_counts(t.matches()).select(*APP_KEY, "g", "gb", "recent_count")


@query("asof_season_table")
def q_asof_season_table(t):
    """League table of each season as of every match date (strictly earlier matches)."""
    return FE.asof_season_table(t.matches()).select(
        "league", "season_year", "as_of", "team", "points", "played", "gd", "points_per_game", "position")


@query("league_position")
def q_league_position(t):
    """Positions, difference and points-per-game of both teams as of kick-off."""
    return FE.league_position(t.matches())


@query("season_progress")
def q_season_progress(t):
    """0-based position in the (league, season) by order key / season match count."""
    return FE.season_progress(t.matches())


@query("label_encode")
def q_label_encode(t):
    """Separate sorted-distinct codes for home team, away team and venue."""
    return FE.label_encode(t.matches())


@query("join_home_away_features")
def q_join_home_away(t):
    """Per-appearance form and streaks brought back to one row per match."""
    return FE.appearance_features(t.matches())


@query("elo_ratings")
def q_elo(t):
    """Elo of both teams before each match (K=32, start 1500, unplayed: no update)."""
    return FE.elo_ratings(t.matches()).select(*MATCH_KEY, "home_elo", "away_elo")


@query("elo_difference")
def q_elo_difference(t):
    """Home minus away Elo before each match."""
    return FE.elo_ratings(t.matches()).select(*MATCH_KEY, "elo_difference")


from . import catalog_clean, catalog_eval, catalog_html, catalog_io, catalog_model, catalog_requests, catalog_stats, catalog_stream  # noqa: E402,F401
