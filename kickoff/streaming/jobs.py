"""Structured Streaming jobs: leaderboard, standings snapshots, Elo ratings.

Each job reads files as they arrive (file source, ``maxFilesPerTrigger``),
keeps its progress in a checkpoint folder, and writes an idempotent sink, so a
restarted or retried micro-batch produces the same result. In production the
trigger is a processing-time interval (15 s leaderboard, 60 min standings);
tests and the registered queries use ``availableNow`` to drain the input.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import constants as C
from ..operators.features import EloBook
from ..operators.stats import leaderboard_entries, leaderboard_rank
from ..session import scratch_scope
from ..sources.html import extract_standings
from ..sources.standings import sink_standings

EVENTS_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string, d date"
PAGES_SCHEMA = "league bigint, season string, html string"
MATCHES_SCHEMA = ("league bigint, match_date date, home_team string, away_team string, home_goals double, "
                  "away_goals double, venue string, result int, season_year int")


def _trigger(writer, available_now: bool, interval: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


# ------------------------------------------------------------ leaderboard

def user_scores(events: DataFrame) -> DataFrame:
    """Running per-user totals: points from purchases (null when none), signups counted."""
    return events.groupBy("user_id").agg(
        F.sum(F.when(F.col("event_type") == "purchase", F.floor("value").cast("bigint"))).alias("points"),
        F.count(F.when(F.col("event_type") == "signup", F.lit(1))).alias("correct_predictions"))


def stream_leaderboard(spark: SparkSession, events_path: str, sink_path: str, checkpoint: str,
                       available_now: bool = True, interval: str = "15 seconds", files_per_trigger: int = 1):
    """Event files -> running user scores (complete mode) -> ranked leaderboard
    rewritten by every micro-batch (overwrite, hence idempotent)."""
    events = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(events_path))
    scores = user_scores(events).withColumn("username", F.concat(F.lit("user_"), F.col("user_id").cast("string")))

    def publish(batch: DataFrame, epoch_id: int) -> None:
        with scratch_scope():  # the ranking's tables go with the batch
            leaderboard_rank(leaderboard_entries(batch)).write.mode("overwrite").parquet(sink_path)

    w = scores.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


# ------------------------------------------------------------ standings

def stream_standings(spark: SparkSession, pages_path: str, store_path: str, checkpoint: str,
                     available_now: bool = True, interval: str = "60 minutes", files_per_trigger: int = 1):
    """Page files -> parsed standings -> replace the snapshot of every (league, season)
    that parsed; a page that yields no table leaves the stored snapshot alone.
    Within one micro-batch the last-arriving page of a season wins."""
    pages = (spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(pages_path)
             .withColumn("arrival", F.col("_metadata.file_modification_time")))

    def apply(batch: DataFrame, epoch_id: int) -> None:
        latest = batch.groupBy("league", "season").agg(F.max_by("html", "arrival").alias("html"))
        rows = extract_standings(latest)
        sink_standings(rows, store_path, partition_cols=("league", "season"))

    w = pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


# ------------------------------------------------------------ Elo

ELO_OUT = ("league bigint, match_date date, home_team string, away_team string, home_elo double, away_elo double")
ELO_STATE = "ratings string"


def _elo_update(k: float, start: float):
    def fn(key, batches, state):
        book = EloBook(k, start, json.loads(state.get[0]) if state.exists else {})
        arrived = pd.concat(list(batches), ignore_index=True).sort_values(["match_date", "home_team", "away_team"])
        before = book.play(arrived["home_team"].tolist(), arrived["away_team"].tolist(), arrived["result"].tolist())
        state.update((json.dumps(book.ratings),))
        yield arrived.drop(columns="result").assign(home_elo=before[:, 0], away_elo=before[:, 1])
    return fn


def stream_elo(spark: SparkSession, matches_path: str, sink_path: str, checkpoint: str,
               available_now: bool = True, interval: str = "1 minute",
               k_factor: float = C.ELO_K, initial_rating: float = C.ELO_START):
    """Match files -> pre-match ratings, state = one rating map per league.

    One micro-batch is one arrival: whatever files have come since the last one, in any
    number of parts, are rated together in match order. A result arriving in a later
    batch is applied when it arrives (no re-rating)."""
    m = (spark.readStream.schema(MATCHES_SCHEMA).parquet(matches_path)
         .select("league", "match_date", "home_team", "away_team", F.col("result").cast("double")))
    out = m.groupBy("league").applyInPandasWithState(
        _elo_update(float(k_factor), float(initial_rating)), ELO_OUT, ELO_STATE, "append",
        GroupStateTimeout.NoTimeout)
    w = out.writeStream.outputMode("append").format("parquet").option("path", sink_path) \
        .option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()
