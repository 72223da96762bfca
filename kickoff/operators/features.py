"""Point-in-time ("as of kick-off") feature operators.

Input is a clean match table with the columns of ``MATCH_KEY`` plus
``home_goals``, ``away_goals`` (double), ``result`` (1/0/-1/null), ``venue``
and ``season_year``; one row per match key. Every feature of a match only
sees matches on strictly earlier dates (Elo excepted: it updates row by row).

Shuffles: appearance features exchange once on (league, team) and once on the
match key to put both sides back on one row; pair features exchange on the
unordered pair; venue features on (league, venue, team); the as-of league
table on (league, season); the feature table on the league. No operator joins on ``date <``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..session import materialize
from .history import MATCH_KEY, day_number, league_ordinals, team_points, team_unpivot
from .joins import join_small


# ---------------------------------------------------------------- helpers

def side_columns(cols: list[str]) -> list[Column]:
    """``home_<c>`` / ``away_<c>`` of an appearance: its own side's filled, the other one null."""
    return [F.when(F.col("is_home") == (side == "home"), F.col(c)).alias(f"{side}_{c}") for c in cols for side in ("home", "away")]


def pivot_sides(apps: DataFrame, cols: list[str], key: list[str] = MATCH_KEY) -> DataFrame:
    """join_home_away_features: one row per match with ``home_<c>`` / ``away_<c>``.

    Both sides of a match are brought together by one aggregation on the match
    key (one exchange) instead of two joins.
    """
    names = [f"{side}_{c}" for c in cols for side in ("home", "away")]
    return apps.select(*key, *side_columns(cols)).groupBy(*key).agg(*[F.max(c).alias(c) for c in names])


# ---------------------------------------------------------------- form

def recent_counts(matches: DataFrame, recent: int = C.RECENT_LEAGUE_MATCHES) -> DataFrame:
    """Appearances with ``g``, ``gb`` and ``recent_count``: the team's matches among the
    league's last ``recent`` before the date (ordinals gb - recent + 1 to gb).

    Appearances and window borders are put on one ordinal axis per team: a running count
    of appearances read at gb and at gb - recent, no list of matches is built.
    """
    apps = team_unpivot(league_ordinals(matches), extra=["g", "gb"])
    key = ["league", "team"]
    events = apps.select(*key, F.col("g").alias("at"), F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("asker"), F.lit(0).alias("sign"))
    for shift, sign in ((0, 1), (recent, -1)):
        events = events.unionByName(apps.select(*key, (F.col("gb") - shift).alias("at"), F.lit(0).alias("one"), F.col("g").alias("asker"), F.lit(sign).alias("sign")))
    upto = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("_c", F.sum("one").over(upto)).where("asker IS NOT NULL")
    per = counted.groupBy(*key, F.col("asker").alias("g")).agg(F.sum(F.col("_c") * F.col("sign")).cast("bigint").alias("recent_count"))
    return apps.join(per, [*key, "g"])


FORM = [c for n in C.FORM_WINDOWS for c in (f"form_{n}", f"goals_form_{n}", f"conceded_form_{n}")]
STREAKS = ["win_streak", "unbeaten_streak", "momentum"]


def form_features(matches: DataFrame, windows=C.FORM_WINDOWS) -> DataFrame:
    """Form columns of both sides (see ``appearance_sides``); they need no league ordinals."""
    names = [f"{side}_{c}" for n in windows for c in (f"form_{n}", f"goals_form_{n}", f"conceded_form_{n}")
             for side in ("home", "away")]
    return pivot_sides(appearance_sides(matches), FORM).select(*MATCH_KEY, *names)


# ---------------------------------------------------------------- momentum & streaks

def momentum_features(matches: DataFrame) -> DataFrame:
    """Streak and momentum columns of both sides (see ``appearance_sides``)."""
    names = [f"{side}_{c}" for c in STREAKS for side in ("home", "away")]
    return pivot_sides(appearance_sides(_with_ordinals(matches)), STREAKS).select(*MATCH_KEY, *names)


def appearance_features(matches: DataFrame) -> DataFrame:
    """Form (3/5/10), win/unbeaten streaks and momentum of both sides, one row per match."""
    return pivot_sides(appearance_sides(_with_ordinals(matches)), FORM + STREAKS)


def _with_ordinals(matches: DataFrame) -> DataFrame:
    # Cut the lineage after the league ordinals (a table written to the shared
    # checkpoint folder): planned as one job with the team windows, the ordinal
    # stages ran about three times slower.
    return materialize(league_ordinals(matches.select(*MATCH_KEY, "home_goals", "away_goals", "result")),
                       "league-ordinals")


def appearance_sides(matches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per appearance: match key, ``is_home``, form and, if ``matches`` has the
    ordinals ``g`` and ``gb``, streaks and momentum. Columns of ``keep`` pass through.

    Per team (one exchange on league, team; one sort), in match order:
    * sums over the last w appearances = running sum - running sum w rows back
      (``lag``), so every step is O(1) and code-generated;
    * win / unbeaten runs before a match = appearances before it - row number of the last
      non-win / loss (running max);
    * the league ordinals and points of the last 15 / 8 appearances are plain
      ``lag`` columns (no arrays).
    They are right as of kick-off at a team's first appearance of a day, and its other
    ones of that day take them from there: same-day matches never see each other. Only
    finished values are carried, so columns not asked for aren't computed. The
    league window ("last 50 league matches") keeps a suffix of that history; streaks
    are capped by its length, counted up to their own span only, as momentum's 8 are.
    """
    ordinals = "g" in matches.columns
    apps = team_unpivot(matches, extra=[*keep, *(["g", "gb"] if ordinals else [])]).withColumn("_day", day_number())
    w = Window.partitionBy("league", "team").orderBy("_day", "home_team", "away_team")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    both = F.col("gf").isNotNull() & F.col("ga").isNotNull()
    won = F.coalesce(F.col("points") == 3, F.lit(False))
    unbeaten = F.coalesce(F.col("points") >= 1, F.lit(False))
    extra = ["g", "gb"] if ordinals else []
    apps = apps.select(
        *MATCH_KEY, *keep, "is_home", "team", "_day", "points", *extra, F.row_number().over(w).alias("rn"),
        F.sum(F.coalesce(F.col("points"), F.lit(0))).over(run).alias("cp"),
        F.sum(F.when(both, F.col("gf")).otherwise(F.lit(0.0))).over(run).alias("cf"),
        F.sum(F.when(both, F.col("ga")).otherwise(F.lit(0.0))).over(run).alias("ca"))
    nb = F.col("rn") - 1
    names, cols = list(FORM), []
    for n in C.FORM_WINDOWS:
        cnt = F.greatest(F.least(nb, F.lit(n)), F.lit(1))
        last = lambda c: F.coalesce(F.lag(c, 1).over(w), F.lit(0)) - F.coalesce(F.lag(c, n + 1).over(w), F.lit(0))  # noqa: B023, E731
        cols += [(last("cp") / (cnt * 3.0)).alias(f"form_{n}"), (last("cf") / cnt).alias(f"goals_form_{n}"),
                 (last("ca") / cnt).alias(f"conceded_form_{n}")]
    if not ordinals:
        return _first_of_day(apps.select(*MATCH_KEY, *keep, "is_home", "team", "_day", *cols), names, keep)
    names += STREAKS
    span_p = C.MOMENTUM_SPAN
    # how many of the last n earlier appearances lie in the league's last 50 matches (the newest ones do)
    inside = [F.when(F.lag("g", j + 1).over(w) > F.col("gb") - C.RECENT_LEAGUE_MATCHES, 1).otherwise(0) for j in range(C.UNBEATEN_STREAK_SPAN)]
    of_last = lambda n: sum(inside[1:n], inside[0])
    run_of = lambda kept: nb - F.coalesce(F.max(F.when(~kept, F.col("rn"))).over(before), F.lit(0))
    apps = apps.select(*MATCH_KEY, *keep, "is_home", "team", "_day", *cols, of_last(C.WIN_STREAK_SPAN).alias("_kw"), of_last(C.UNBEATEN_STREAK_SPAN).alias("_ku"),
                       of_last(span_p).alias("_take"), run_of(won).alias("_wins"), run_of(unbeaten).alias("_unbeaten"),
                       *[F.lag("points", j + 1).over(w).alias(f"_q{j + 1}") for j in range(span_p)])
    # momentum: newest first over the last ``_take``; unplayed skipped, weight 0.9^(played entries before).
    # From the oldest on, every played one lowers what is older by 0.9 (Horner): a short expression
    mom, tw = F.lit(0.0), F.lit(0.0)
    for j in reversed(range(span_p)):
        use = (F.lit(j) < F.col("_take")) & F.col(f"_q{j + 1}").isNotNull()
        decay = F.when(use, F.lit(C.MOMENTUM_DECAY)).otherwise(1.0)
        mom = mom * decay + F.when(use, F.col(f"_q{j + 1}") / 3.0).otherwise(0.0)
        tw = tw * decay + F.when(use, 1.0).otherwise(0.0)
    momentum = F.when((F.col("_take") > 0) & (tw > 0), mom / tw).otherwise(F.lit(C.MOMENTUM_DEFAULT))
    return _first_of_day(apps.select(
        *MATCH_KEY, *keep, "is_home", "team", "_day", *FORM, F.least("_wins", "_kw").alias("win_streak"),
        F.least("_unbeaten", "_ku").alias("unbeaten_streak"), momentum.alias("momentum")), names, keep)


def _first_of_day(apps: DataFrame, names: list[str], keep: tuple[str, ...]) -> DataFrame:
    """Every appearance with the values of its team's first one that day (the order of the team windows goes on)."""
    day = Window.partitionBy("league", "team", "_day").orderBy("home_team", "away_team").rowsBetween(Window.unboundedPreceding, 0)
    return apps.select(*MATCH_KEY, *keep, "is_home", *[F.first(c).over(day).alias(c) for c in names])


# ---------------------------------------------------------------- head to head

def head_to_head(matches: DataFrame, max_matches: int = C.H2H_MAX, keep: tuple[str, ...] = ()) -> DataFrame:
    """Last ``max_matches`` earlier meetings of the pair, either venue order.

    Per unordered pair (one exchange), each meeting is scored from the side of
    the alphabetically first team; sliding ROWS sums over the ``max_matches``
    meetings before it hold at the pair's first one of a day, its others that day take
    them from there, and all are turned to the current home team's perspective. Unplayed meetings count
    in n and add nothing. Columns of ``keep`` pass through.
    """
    m = (matches.select(*dict.fromkeys([*MATCH_KEY, "home_goals", "away_goals", "result", *keep]))
         .withColumn("pair_lo", F.least("home_team", "away_team"))
         .withColumn("pair_hi", F.greatest("home_team", "away_team"))
         .withColumn("_day", day_number()))
    played = F.col("result").isNotNull()
    lo_home = F.col("home_team") == F.col("pair_lo")
    signed = F.when(lo_home, F.col("result")).otherwise(-F.col("result"))  # +1: first team won
    one = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 1).otherwise(0)
    lo_goals = F.when(played, F.when(lo_home, F.col("home_goals")).otherwise(F.col("away_goals"))).otherwise(0.0)
    hi_goals = F.when(played, F.when(lo_home, F.col("away_goals")).otherwise(F.col("home_goals"))).otherwise(0.0)
    part = ["league", "pair_lo", "pair_hi"]
    w = Window.partitionBy(*part).orderBy("_day", "home_team", "away_team")
    fr = w.rowsBetween(-max_matches, -1)
    st = m.select(*MATCH_KEY, *keep, "pair_lo", "pair_hi", "_day", (F.row_number().over(w) - 1).alias("nb"),
                  F.sum(one(signed == 1)).over(fr).alias("lw"), F.sum(one(signed == -1)).over(fr).alias("hw"),
                  F.sum(one(F.col("result") == 0)).over(fr).alias("dr"),
                  F.sum(F.coalesce(lo_goals, F.lit(0.0))).over(fr).alias("lg"),
                  F.sum(F.coalesce(hi_goals, F.lit(0.0))).over(fr).alias("hg"))
    day = Window.partitionBy(*part, "_day").orderBy("home_team", "away_team").rowsBetween(Window.unboundedPreceding, 0)
    prev = st.select(*MATCH_KEY, *keep, "pair_lo", *[F.first(c).over(day).alias(c) for c in ("nb", "lw", "hw", "dr", "lg", "hg")])
    n = F.least("nb", F.lit(max_matches))
    cur_lo = F.col("home_team") == F.col("pair_lo")
    hw = F.when(cur_lo, F.col("lw")).otherwise(F.col("hw"))
    aw = F.when(cur_lo, F.col("hw")).otherwise(F.col("lw"))
    hgoals = F.when(cur_lo, F.col("lg")).otherwise(F.col("hg"))
    agoals = F.when(cur_lo, F.col("hg")).otherwise(F.col("lg"))
    d = C.H2H_DEFAULTS
    none = n == 0
    return prev.select(
        *MATCH_KEY, *keep,
        F.when(none, d["h2h_home_wins"]).otherwise(hw / n).alias("h2h_home_wins"),
        F.when(none, d["h2h_away_wins"]).otherwise(aw / n).alias("h2h_away_wins"),
        F.when(none, d["h2h_draws"]).otherwise(F.col("dr") / n).alias("h2h_draws"),
        F.when(none, d["h2h_home_goals_avg"]).otherwise(hgoals / n).alias("h2h_home_goals_avg"),
        F.when(none, d["h2h_away_goals_avg"]).otherwise(agoals / n).alias("h2h_away_goals_avg"),
        F.when(none, d["h2h_total_goals_avg"]).otherwise((hgoals + agoals) / n).alias("h2h_total_goals_avg"),
        n.cast("bigint").alias("h2h_matches_count"))


# ---------------------------------------------------------------- venue

def venue_features(matches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Earlier matches at the same venue with the same home (resp. away) team:
    share of points taken; unplayed count in the denominator. Columns of ``keep`` pass through."""
    m = matches.select(*dict.fromkeys([*MATCH_KEY, "venue", "result", *keep])).withColumn("_day", day_number())
    hp = F.coalesce(team_points(F.col("result"), F.lit(True)), F.lit(0))
    ap = F.coalesce(team_points(F.col("result"), F.lit(False)), F.lit(0))
    wh = Window.partitionBy("league", "venue", "home_team").orderBy("_day").rangeBetween(
        Window.unboundedPreceding, -1)
    wa = Window.partitionBy("league", "venue", "away_team").orderBy("_day").rangeBetween(
        Window.unboundedPreceding, -1)
    m = (m.withColumn("_hn", F.count(F.lit(1)).over(wh)).withColumn("_hp", F.sum(hp).over(wh))
          .withColumn("_an", F.count(F.lit(1)).over(wa)).withColumn("_ap", F.sum(ap).over(wa)))
    return m.select(
        *MATCH_KEY, *keep,
        F.when(F.col("_hn") > 0, F.col("_hp") / (F.col("_hn") * 3.0))
         .otherwise(F.lit(C.VENUE_HOME_DEFAULT)).alias("home_venue_advantage"),
        F.when(F.col("_an") > 0, F.col("_ap") / (F.col("_an") * 3.0))
         .otherwise(F.lit(C.VENUE_AWAY_DEFAULT)).alias("away_venue_performance"))


# ---------------------------------------------------------------- league table

def _rank_table(df: DataFrame, part: list[str]) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(F.desc("points"), F.desc("gd"), F.asc("team"))
    return (df.withColumn("points_per_game", F.col("points") / F.greatest(F.col("played"), F.lit(1)))
              .withColumn("position", F.row_number().over(w)))


def team_deltas(matches: DataFrame, by: list[str]) -> DataFrame:
    """Per (by..., team): points, played, goal difference; unplayed only lists the team."""
    apps = team_unpivot(matches, extra=[c for c in by if c not in MATCH_KEY])
    played = F.col("result").isNotNull()
    gd_ok = played & F.col("gf").isNotNull() & F.col("ga").isNotNull()
    return apps.groupBy(*by, "team").agg(
        F.sum(F.when(played, F.col("points")).otherwise(0)).cast("bigint").alias("points"),
        F.sum(F.when(played, 1).otherwise(0)).cast("bigint").alias("played"),
        F.sum(F.when(gd_ok, F.col("gf") - F.col("ga")).otherwise(0.0)).alias("gd"))


def league_table(matches: DataFrame) -> DataFrame:
    """Final table per (league, season_year): points, played, gd, ppg, position.

    Ties: points desc, goal difference desc, team ascending.
    """
    t = team_deltas(matches, ["league", "season_year"])
    return _rank_table(t, ["league", "season_year"])


def _season_states(matches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Appearances, and between them the state that a team takes into each match date of its season.

    Rows: (league, season_year, ``_at`` the number of the match date in its season, team),
    ``is_state`` and, in states, points, played and gd of strictly earlier dates; other rows
    are the appearances with their match key. A team's last appearance of a day spreads its
    state over the match dates to its next one (bounded by the season's dates, never by the
    data volume). All steps go by (league, season): one exchange, no join on ``date <``.
    Appearances keep their match's columns of ``keep``, null in states.
    """
    m = matches.select(*dict.fromkeys([*MATCH_KEY, "season_year", "home_goals", "away_goals", "result", *keep])).repartition("league", "season_year")
    apps = team_unpivot(m, extra=["season_year", *(c for c in keep if c not in ("home_goals", "away_goals", "result"))])
    season = Window.partitionBy("league", "season_year")
    team = Window.partitionBy("league", "season_year", "team")
    upto = team.orderBy("match_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    played = F.col("result").isNotNull()
    gd_ok = played & F.col("gf").isNotNull() & F.col("ga").isNotNull()
    apps = apps.select(*MATCH_KEY, "season_year", "team", "is_home", *keep, F.when(played, F.col("points")).otherwise(0).alias("_p"), F.when(played, 1).otherwise(0).alias("_n"),
                       F.when(gd_ok, F.col("gf") - F.col("ga")).otherwise(0.0).alias("_d"), F.dense_rank().over(season.orderBy("match_date")).alias("_at"))
    apps = apps.select(*MATCH_KEY, "season_year", "team", "is_home", *keep, "_at", F.sum("_p").over(upto).cast("bigint").alias("points"), F.sum("_n").over(upto).cast("bigint").alias("played"),
                       F.sum("_d").over(upto).alias("gd"), F.lead("_at").over(team.orderBy("match_date", "home_team", "away_team")).alias("_next"), F.max("_at").over(season).alias("_last"))
    until = F.coalesce("_next", "_last")
    spread = (F.col("_at") < until) & F.col("league").isNotNull() & F.col("season_year").isNotNull() & F.col("match_date").isNotNull()
    own = F.array(F.struct(F.col("_at"), F.lit(False).alias("is_state")))
    states = F.when(spread, F.transform(F.sequence(F.col("_at") + 1, until), lambda at: F.struct(at.alias("_at"), F.lit(True).alias("is_state"))))
    return apps.withColumn("_s", F.explode(F.concat(own, F.coalesce(states, F.array_remove(own, own[0]))))).select(
        *MATCH_KEY, "season_year", "team", "is_home", *[F.when(~F.col("_s.is_state"), F.col(c)).alias(c) for c in keep], "_s._at", "_s.is_state", "points", "played", "gd")


def asof_season_table(matches: DataFrame) -> DataFrame:
    """The league table of each (league, season) as of every match date in it,
    counting only matches on strictly earlier dates of the same season.

    Teams' states on the season's match dates (see ``_season_states``), ranked per date; the
    dates are put back by their number.
    """
    numbered = Window.partitionBy("league", "season_year").orderBy("match_date")
    dates = matches.select("league", "season_year", "match_date").distinct().select(
        "league", "season_year", F.col("match_date").alias("as_of"), F.dense_rank().over(numbered).alias("_at"))
    grid = _season_states(matches).where("is_state").select("league", "season_year", "_at", "team", "points", "played", "gd")
    return _rank_table(grid, ["league", "season_year", "_at"]).join(dates, ["league", "season_year", "_at"]).select(
        "league", "season_year", "as_of", "team", "points", "played", "gd", "points_per_game", "position")


def league_position_sides(matches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per appearance: match key, season, ``is_home``, the match's columns of ``keep``,
    league position and points per game as of kick-off."""
    ranked = _rank_table(_season_states(matches, keep), ["league", "season_year", "_at", "is_state"])
    own = Window.partitionBy("league", "season_year", "_at", "team")
    found = lambda c, default: F.coalesce(F.when(F.col("team").isNotNull(), F.max(F.when(F.col("is_state"), F.col(c))).over(own)), F.lit(default))
    return ranked.select(*MATCH_KEY, "season_year", "is_home", *keep, "is_state", found("position", C.POSITION_DEFAULT).cast("bigint").alias("league_position"),
                         found("points_per_game", C.PPG_DEFAULT).alias("points_per_game")).where(~F.col("is_state")).drop("is_state")


def league_position(matches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """home/away league position and points-per-game as of kick-off. Columns of ``keep`` pass through."""
    # a match has one season: with it in the key both sides meet where the season lies
    places = ["league_position", "points_per_game"]
    key = [*MATCH_KEY, "season_year"]
    kept = [c for c in keep if c not in key]
    sides = league_position_sides(matches, tuple(kept)).select(*key, *kept, *side_columns(places))
    both = sides.groupBy(*key).agg(*[F.max(c).alias(c) for c in sides.columns if c not in key])
    return both.select(
        *MATCH_KEY, *keep, "home_league_position", "away_league_position",
        (F.col("home_league_position") - F.col("away_league_position")).alias("position_difference"),
        "home_points_per_game", "away_points_per_game")


# ---------------------------------------------------------------- Elo

ELO_SCHEMA = ("league bigint, match_date date, home_team string, away_team string, "
              "home_elo double, away_elo double")


class EloBook:
    """Ratings of one league's teams, moved match by match in order."""

    def __init__(self, k: float, start: float, ratings: dict[str, float] | None = None):
        self.k, self.start = k, start
        self.ratings = {} if ratings is None else ratings

    def play(self, homes: list, aways: list, results: list) -> np.ndarray:
        """Both ratings before each match; result 1/0/-1 for the home side, anything else leaves them."""
        before = np.empty((len(results), 2))
        book, k = self.ratings, self.k
        for i, (h, a, result) in enumerate(zip(homes, aways, results)):
            pair = before[i] = book.get(h, self.start), book.get(a, self.start)
            if result in (1, 0, -1):
                # what the home side wins over its expectation the away side loses
                change = k * ((result + 1) / 2 - 1 / (1 + 10 ** ((pair[1] - pair[0]) / 400)))
                book[h], book[a] = pair[0] + change, pair[1] - change
        return before


def _elo_stream(k: float, start: float, only: str | None):
    """Rows sorted by league and match order, batch by batch; between batches only one league's ratings are held.
    All are played, those without the flag ``only`` (if one is named) aren't returned."""
    def rate(batches):
        league, book = None, None
        for pdf in batches:
            rated = []
            for name, part in pdf.groupby("league", sort=False, dropna=False):
                if book is None or name != league:
                    league, book = name, EloBook(k, start)
                before = book.play(part["home_team"].tolist(), part["away_team"].tolist(), part["result"].tolist())
                out = part.drop(columns="result").assign(home_elo=before[:, 0], away_elo=before[:, 1])
                rated.append(out[out[only]].drop(columns=only) if only else out)
            if rated:
                yield pd.concat(rated)
    return rate


def elo_ratings(matches: DataFrame, k_factor: float = C.ELO_K,
                initial_rating: float = C.ELO_START, only: str | None = None) -> DataFrame:
    """Rating of both teams *before* each match (each one flagged by the column ``only``, if
    named); unplayed matches do not update.

    Elo is an ordered fold, sequential inside a league. Leagues are dealt over the
    partitions and sorted by Spark (which spills); Python streams through the sorted rows
    and holds one league's rating map, not its matches.
    """
    m = matches.select("league", "match_date", "home_team", "away_team", F.col("result").cast("double"), *([only] if only else []))
    ordered = m.repartition("league").sortWithinPartitions("league", "match_date", "home_team", "away_team")
    out = ordered.mapInPandas(_elo_stream(float(k_factor), float(initial_rating), only), ELO_SCHEMA)
    return out.withColumn("elo_difference", F.col("home_elo") - F.col("away_elo"))


# ---------------------------------------------------------------- encoders, progress, fill

def season_progress(matches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """0-based position of the match in its (league, season) by order key / season size.

    One exchange and one sort by (league, season), no join. Columns of ``keep`` pass through;
    with them matches without a league, season or date stay, their progress null.
    """
    season = Window.partitionBy("league", "season_year")
    known = F.col("league").isNotNull() & F.col("season_year").isNotNull() & F.col("match_date").isNotNull()
    place = F.row_number().over(season.orderBy(F.asc_nulls_last("match_date"), "home_team", "away_team")) - 1
    m = matches if keep else matches.where(known)
    return m.select(*MATCH_KEY, *keep, F.when(known, place / F.count("match_date").over(season)).alias("season_progress"))


def dense_codes(values: DataFrame, col: str, out: str) -> DataFrame:
    """(value, code) with code = index of the value among its sorted distinct values.

    A global dense rank computed without a single-partition window: distinct
    values are range-partitioned and sorted, every partition counts its rows,
    the (tiny, one row per partition) counts are prefix-summed, and each row's
    code is its partition offset + its position inside the partition.
    """
    from .ranking import global_index
    d = values.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    return global_index(d, ["_v"], "_idx").select(F.col("_v").alias(col), F.col("_idx").alias(out))


def label_encode(matches: DataFrame, keep: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """home_team_encoded, away_team_encoded (separate codes) and venue_encoded (null -> Unknown).

    The codes are those of the rows of ``known`` (the same matches, if these are costly to
    read again). Columns of ``keep`` pass through; with them matches without a team stay.
    """
    venue = F.coalesce("venue", F.lit(C.UNKNOWN_VENUE)).alias("_venue")
    m = matches.select(*MATCH_KEY, *keep, venue)
    values = (matches if known is None else known).select("home_team", "away_team", venue)
    out = m if keep else m.where(F.col("home_team").isNotNull() & F.col("away_team").isNotNull())
    for c, code in (("home_team", "home_team_encoded"), ("away_team", "away_team_encoded"), ("_venue", "venue_encoded")):
        out = join_small(out, dense_codes(values, c, code), c, "left")
    return out.select(*MATCH_KEY, *keep, "home_team_encoded", "away_team_encoded", "venue_encoded")


def median_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null features -> the exact (interpolated) median of the column over all rows."""
    from .ranking import exact_medians
    counts = df.agg(*[F.count(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1)).alias(c) for c in cols]).first() if cols else {}
    med = exact_medians(df, [c for c in cols if counts[c]])
    return df.na.fill({c: float(v) for c, v in med.items() if v is not None})


# ---------------------------------------------------------------- matrix

# --- fixed values: the model's features in order ---
FEATURE_COLUMNS = [
    "home_team_encoded", "away_team_encoded",
    "home_elo", "away_elo", "elo_difference",
    "home_form_3", "away_form_3", "home_form_5", "away_form_5", "home_form_10", "away_form_10",
    "home_goals_form_3", "away_goals_form_3", "home_goals_form_5", "away_goals_form_5",
    "home_conceded_form_3", "away_conceded_form_3", "home_conceded_form_5", "away_conceded_form_5",
    "h2h_home_wins", "h2h_away_wins", "h2h_draws",
    "h2h_home_goals_avg", "h2h_away_goals_avg", "h2h_total_goals_avg", "h2h_matches_count",
    "home_venue_advantage", "away_venue_performance",
    "home_win_streak", "away_win_streak", "home_unbeaten_streak", "away_unbeaten_streak",
    "home_momentum", "away_momentum",
    "home_league_position", "away_league_position", "position_difference",
    "home_points_per_game", "away_points_per_game",
    "month", "day_of_week", "is_weekend", "season_progress",
    "venue_encoded",
]


def feature_table(matches: DataFrame, only: str | None = None) -> DataFrame:
    """Every feature family brought together on the match key (unfilled).

    If ``only`` names a flag of the matches, all of them make the features but only flagged ones get
    a row: each family is cut down to them before the families meet.

    Leagues are dealt once: the families of match rows are columns added one after the other
    where the league lies, and so are the ordinals that the appearances need (Elo, which is
    sequential in a league, sets the longest task anyway). These rows, the Elo ratings and the
    two sides with their form and league position then meet in one aggregation on the match
    key; what follows from the key or other features is added behind it.
    """
    base = ("season_year", "home_goals", "away_goals", "result", "venue")
    flag = (only,) if only else ()
    wanted = lambda df: df.where(only).drop(only) if only else df
    dealt = matches.select(*MATCH_KEY, *base, *flag).repartition("league")
    rows, kept = dealt, base + flag
    for family in (season_progress, head_to_head, venue_features):
        rows = family(rows, keep=kept)
        kept = tuple(c for c in rows.columns if c not in MATCH_KEY)
    rows = label_encode(wanted(rows), tuple(c for c in kept if c not in ("venue", only)), matches)
    order = Window.partitionBy("league").orderBy("_day", "home_team", "away_team")
    earlier = Window.partitionBy("league").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_day", day_number()).select(
        *MATCH_KEY, *flag, "home_goals", "away_goals", "result", F.row_number().over(order).cast("bigint").alias("g"),
        F.coalesce(F.count(F.lit(1)).over(earlier), F.lit(0)).alias("gb"))
    places = ["league_position", "points_per_game"]
    parts = [elo_ratings(matches, only=only).drop("elo_difference"), wanted(appearance_sides(placed, flag)).select(*MATCH_KEY, *side_columns(FORM + STREAKS)),
             wanted(league_position_sides(matches, flag)).select(*MATCH_KEY, *side_columns(places))]
    out = rows
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    # every column has one row per match: the one value that is not null
    out = out.groupBy(*MATCH_KEY).agg(*[F.max(c).alias(c) for c in out.columns if c not in MATCH_KEY])
    weekday = F.weekday("match_date")
    return out.withColumns({
        "elo_difference": F.col("home_elo") - F.col("away_elo"), "position_difference": F.col("home_league_position") - F.col("away_league_position"),
        "month": F.month("match_date"), "day_of_week": weekday, "is_weekend": weekday.isin(5, 6).cast("int")})


def feature_matrix(matches: DataFrame, fill: bool = True, only: str | None = None) -> DataFrame:
    """Match key + the selected feature columns in order + targets (see ``feature_table`` for ``only``)."""
    t = feature_table(matches, only)
    cols = [c for c in FEATURE_COLUMNS if c in t.columns]
    t = t.select(*MATCH_KEY, "season_year", *[F.col(c).cast("double").alias(c) for c in cols],
                 "home_goals", "away_goals", "result")
    return median_fill(t, cols) if fill else t
