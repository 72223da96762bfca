"""Queries for cleaning projections, filters and scalar functions (2.2 - 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..operators import clean as CL
from ..operators.history import MATCH_KEY
from .registry import query


def _canon(t):
    return CL.canon_team_names(t.raw_matches(), t.team_aliases())


def _clean(t):
    return CL.preprocess(t.raw_matches(), t.team_aliases())


# ------------------------------------------------------------ 2.2 projections

@query("canon_team_names")
def q_canon(t):
    """Whole-value alias mapping of both team columns (before trimming)."""
    return _canon(t).select("league", "date", "home_team", "away_team")


@query("trim_team_names")
def q_trim(t):
    """Aliases mapped, then leading/trailing whitespace stripped."""
    return CL.trim_team_names(_canon(t)).select("league", "date", "home_team", "away_team")


@query("parse_match_date")
def q_parse_date(t):
    """ISO date text -> DATE, anything else -> null."""
    return CL.parse_match_date(t.raw_matches()).select("league", "date", "match_date")


@query("calendar_parts")
def q_calendar(t):
    """year, month, day_of_week (Monday = 0) and is_weekend of the parsed date."""
    return CL.calendar_parts(CL.parse_match_date(t.raw_matches())).select(
        "date", "year", "month", "day_of_week", "is_weekend")


@query("season_year")
def q_season_year(t):
    """Season start year: month >= 8 -> year, else year - 1."""
    return CL.add_season_year(CL.parse_match_date(t.raw_matches())).select("date", "season_year")


@query("clean_scores")
def q_clean_scores(t):
    """Goals read as numbers; outside [0, 10] or unreadable -> null, side by side."""
    return CL.clean_scores(t.raw_matches()).select(
        "league", "date", F.col("home_goals"), F.col("away_goals"))


@query("encode_result")
def q_encode_result(t):
    """1 / 0 / -1 from cleaned goals; null when either is null."""
    return CL.encode_result(CL.clean_scores(t.raw_matches())).select(
        "league", "date", "home_goals", "away_goals", "result")


@query("clean_venue")
def q_clean_venue(t):
    """Venue stripped, null -> Unknown, fixed aliases applied."""
    return CL.clean_venue(t.raw_matches()).select("league", "date", "venue")


@query("clean_attendance")
def q_clean_attendance(t):
    """Attendance without ',' and '.', as a number; outside [0, 100000] -> null."""
    return CL.clean_attendance(t.raw_matches()).select("league", "date", "attendance")


@query("derived_goals")
def q_derived_goals(t):
    """total_goals and goal_difference of the clean table."""
    return _clean(t).select(*MATCH_KEY, "total_goals", "goal_difference")


@query("match_flags")
def q_match_flags(t):
    """high_scoring, low_scoring, competitive, is_midweek (unknown -> 0)."""
    return _clean(t).select(*MATCH_KEY, "high_scoring", "low_scoring", "competitive", "is_midweek")


@query("month_category")
def q_month_category(t):
    """early / mid / late season by month; June and July -> null."""
    return _clean(t).select(*MATCH_KEY, "month", "month_category")


@query("drop_columns")
def q_drop_columns(t):
    """Tolerant drop of the twelve listed columns from the clean table."""
    return CL.drop_columns(_clean(t))


@query("select_existing")
def q_select_existing(t):
    """The raw-CSV column list, keeping only the columns that exist, in order."""
    return CL.select_existing(t.raw_matches(), C.RAW_COLUMNS)


@query("season_label")
def q_season_label(t):
    """'<y>-<y+1>' label of each clean match's season."""
    return _clean(t).select(*MATCH_KEY, S.season_label("season_year").alias("season"))


@query("prediction_format")
def q_prediction_format(t):
    """Predicted goals rounded half-even and clamped at 0, 'h-a' text, result label."""
    p = t.predictions()
    h = S.round_half_even_nonneg("pred_home_goals")
    a = S.round_half_even_nonneg("pred_away_goals")
    return p.select(*MATCH_KEY, h.alias("predicted_home_goals"), a.alias("predicted_away_goals"),
                    F.concat_ws("-", h.cast("string"), a.cast("string")).alias("predicted_score"),
                    S.result_to_name("pred_result").alias("predicted_result"))


@query("standings_display")
def q_standings_display(t):
    """Snapshot rows with position (snapshot order) and gd = goals for - against."""
    from ..sources.standings import standings_snapshot, standings_display
    return standings_display(standings_snapshot(t.matches()))


# ------------------------------------------------------------ 2.3 filters

@query("drop_invalid_matches")
def q_drop_invalid(t):
    """Clean rows left after removing null teams, self-matches and null dates."""
    return _clean(t).select(*MATCH_KEY, "home_goals", "away_goals", "result", "venue", "attendance")


@query("drop_invalid_report")
def q_drop_invalid_report(t):
    """Rows read, kept and removed by the removal of invalid matches, counted while it writes."""
    from ..session import scratch_path
    counts = CL.drop_invalid_counted(CL.before_drop(t.raw_matches(), t.team_aliases()), scratch_path(t.spark, "valid-matches"))
    return t.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} bigint" for c in counts))


@query("filter_scraped_rows")
def q_filter_scraped(t):
    """Raw rows kept after dropping short team names and repeated header rows."""
    return CL.filter_scraped_rows(t.raw_matches()).select("league", "date", "home_team", "away_team")


@query("split_past_future")
def q_split(t):
    """Past (score and result known) vs fixtures to score, per league and season."""
    past, future = CL.split_past_future(_clean(t))
    return (past.withColumn("part", F.lit("past")).unionByName(future.withColumn("part", F.lit("future")))
            .groupBy("league", "season_year", "part").agg(F.count(F.lit(1)).alias("matches")))


@query("season_filter")
def q_season_filter(t):
    """Rows of one season label (the latest season present)."""
    c = _clean(t).withColumn("season", S.season_label("season_year"))
    latest = c.agg(F.max("season").alias("s"))
    return c.join(latest, c["season"] == latest["s"], "left_semi").select(*MATCH_KEY, "season")


@query("find_duplicates")
def q_find_duplicates(t):
    """(date, home, away) keys of the clean table that repeat, with extra copies."""
    return CL.find_duplicates(_clean(t).drop("date").withColumnRenamed("match_date", "date"),
                              ("date", "home_team", "away_team"))


@query("time_split")
def q_time_split(t):
    """First floor(0.8 n) past matches of each league by order key -> train."""
    return CL.time_split(t.matches()).select(*MATCH_KEY, "g", "is_train")


# ------------------------------------------------------------ 2.4 scalar functions

@query("parse_score")
def q_parse_score(t):
    """First two digit runs of the score text -> goals; otherwise nulls."""
    p = S.parse_score("score")
    return t.raw_matches().select("league", "date", "score", p.home_goals.alias("home_goals"),
                                  p.away_goals.alias("away_goals"))


@query("parse_date_text")
def q_parse_date_text(t):
    """Spanish/English date spellings -> ISO text; unparsable -> rewritten text."""
    return t.raw_matches().select("league", "date_text", S.parse_date_text("date_text").alias("parsed"))


@query("result_label")
def q_result_label(t):
    """Home Win / Away Win / Draw / Unknown from parsed score goals."""
    p = S.parse_score("score")
    return t.raw_matches().select("league", "date", "score",
                                  S.result_label(p.home_goals, p.away_goals).alias("result_label"))


@query("result_to_name")
def q_result_to_name(t):
    """1 / 0 / -1 -> result name."""
    return t.matches().select(*MATCH_KEY, "result", S.result_to_name("result").alias("result_name"))


@query("slugify")
def q_slugify(t):
    """Slugs of every team name and venue."""
    m = t.matches()
    names = (m.select(F.col("home_team").alias("name")).union(m.select(F.col("away_team").alias("name")))
             .union(m.select(F.col("venue").alias("name"))).distinct())
    return names.select("name", S.slugify("name").alias("slug"))


@query("initials")
def q_initials(t):
    """Placeholder initials of every team slug."""
    m = t.matches()
    teams = m.select(F.col("home_team").alias("team")).union(m.select(F.col("away_team").alias("team"))).distinct()
    slugs = teams.select("team", S.slugify("team").alias("slug"))
    return slugs.select("team", "slug", S.initials("slug").alias("initials"))


@query("palette_index")
def q_palette(t):
    """Placeholder colour per team, by order of first appearance, cycling six colours."""
    from ..operators.sets import teams_by_first_appearance
    ordered = teams_by_first_appearance(t.matches())
    return ordered.select("team", "ordinal", S.palette_colour(F.col("ordinal") + 1).alias("colour"))


@query("elo_expected")
def q_elo_expected(t):
    """Expected home score from the pre-match Elo ratings."""
    from ..operators.features import elo_ratings
    e = elo_ratings(t.matches())
    return e.select(*MATCH_KEY, S.elo_expected("home_elo", "away_elo").alias("expected_home"))
