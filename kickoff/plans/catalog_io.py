"""Queries for sources and sinks (2.1): each writes data derived from the
driver tables to the shared scratch folder and reads it back with the
library's reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.sets import slug_sources
from ..session import scratch_path
from ..sources import files as IO
from ..sources import standings as SD
from .registry import query

RAW_CSV_COLUMNS = ["league", "date", "date_text", "home_team", "away_team", "home_goals", "away_goals",
                   "score", "venue", "attendance"]


@query("scan_matches_csv")
def q_scan_matches_csv(t):
    """Raw match CSV read with an all-text schema; pandas' missing markers -> null."""
    path = scratch_path(t.spark, "raw-csv")
    IO.sink_csv(t.raw_matches(), path)
    return IO.scan_matches_csv(t.spark, path, RAW_CSV_COLUMNS)


@query("sink_csv")
def q_sink_csv(t):
    """Clean matches written as CSV with a header and read back with their types."""
    path = scratch_path(t.spark, "matches-csv")
    IO.sink_csv(t.matches(), path)
    schema = "league bigint, match_date date, home_team string, away_team string, home_goals double, " \
             "away_goals double, venue string, result int, season_year int"
    return t.spark.read.schema(schema).option("header", True).csv(path)


def _prediction_rows(t):
    p = t.predictions()
    return p.select(S.season_label("season_year").alias("season"), F.col("match_date").alias("date"),
                    "home_team", "away_team",
                    S.round_half_even_nonneg("pred_home_goals").alias("pred_home_goals"),
                    S.round_half_even_nonneg("pred_away_goals").alias("pred_away_goals"),
                    F.col("pred_result").cast("double").alias("pred_result"))


@query("scan_predictions_csv")
def q_scan_predictions_csv(t):
    """Predictions CSV read back as text, missing -> ''."""
    path = scratch_path(t.spark, "predictions-csv")
    IO.sink_csv(_prediction_rows(t), path)
    return IO.scan_predictions_csv(t.spark, path)


@query("scan_fixtures_csv")
def q_scan_fixtures_csv(t):
    """Unplayed fixtures written as CSV (home, away, date, venue) and read back."""
    path = scratch_path(t.spark, "fixtures-csv")
    fx = t.matches().where(F.col("result").isNull()).select(
        "home_team", "away_team", F.col("match_date").cast("string").alias("date"), "venue")
    IO.sink_csv(fx, path)
    return IO.scan_fixtures_csv(t.spark, path)


@query("sink_standings")
def q_sink_standings(t):
    """Write every season's snapshot, then replace only the latest season; read all back."""
    path = scratch_path(t.spark, "standings")
    snap = SD.standings_snapshot(t.matches())
    SD.sink_standings(snap, path)
    latest = snap.agg(F.max("season").alias("s"))
    SD.sink_standings(snap.join(latest, snap["season"] == latest["s"], "left_semi"), path)
    return SD.scan_standings_json(t.spark, path)


@query("scan_standings_json")
def q_scan_standings_json(t):
    """Read one season's stored snapshot (partition pruning on the season folder)."""
    path = scratch_path(t.spark, "standings")
    snap = SD.standings_snapshot(t.matches())
    SD.sink_standings(snap, path)
    season = snap.agg(F.max("season")).first()[0]
    return SD.scan_standings_json(t.spark, path, season)


@query("sink_slug_map")
def q_sink_slug_map(t):
    """Teams and stadiums slug maps written as map documents; entries read back."""
    path = scratch_path(t.spark, "slug-map")
    IO.sink_slug_map(slug_sources(t.matches()), path)
    teams = IO.scan_slug_map(t.spark, path).select(F.lit("team").alias("kind"), "name", F.col("id").alias("slug"))
    return teams.union(IO.scan_stadium_map(t.spark, path).select(F.lit("stadium").alias("kind"), "name", "slug"))


@query("scan_slug_map")
def q_scan_slug_map(t):
    """Team rows (id, name, short_name, logo_url) from the slug map."""
    path = scratch_path(t.spark, "slug-map")
    IO.sink_slug_map(slug_sources(t.matches()), path)
    return IO.scan_slug_map(t.spark, path)

