"""Streams drained with availableNow equal their batch twins."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from conftest import SMALL
from kickoff.operators import features as FE
from kickoff.operators.history import MATCH_KEY


def test_stream_elo_equals_batch(spark, tables):
    s = entry.queries()["stream_elo"](spark, SMALL)
    b = FE.elo_ratings(tables.matches()).select(*MATCH_KEY, "home_elo", "away_elo")
    s = s.select(*MATCH_KEY, F.round("home_elo", 6).alias("home_elo"), F.round("away_elo", 6).alias("away_elo"))
    b = b.select(*MATCH_KEY, F.round("home_elo", 6).alias("home_elo"), F.round("away_elo", 6).alias("away_elo"))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_stream_leaderboard_equals_batch(spark):
    q = entry.queries()
    s = q["stream_leaderboard"](spark, SMALL)
    b = q["leaderboard_rank"](spark, SMALL)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
