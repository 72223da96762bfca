"""Queries for the streaming jobs (2.12): inputs are split into arrival files,
the stream drains them with ``availableNow``, the sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.html import standings_pages
from ..sources.standings import standings_snapshot
from ..streaming import jobs as J
from .registry import query


# A crawl's pages come in so many files at most, however many seasons it has: with a file a
# page the micro-batches, which cost seconds each, grew with the leagues.
PAGE_FILES, LATE_FILES = 64, 8


def arrive(pages, path, files):
    """Pages (league, season, html) added to an arrival folder; a season's pages lie in one file."""
    pages.select("league", "season", "html").repartition(files, "league", "season").write.mode("append").json(path)


@query("stream_leaderboard")
def q_stream_leaderboard(t):
    """Events arrive one day per file (a week per micro-batch); the running
    leaderboard is re-ranked per batch."""
    spark = t.spark
    src, sink, ckpt = (scratch_path(spark, n) for n in ("events-in", "leaderboard", "leaderboard-ckpt"))
    ev = t.table("events").withColumn("d", F.to_date("ts"))
    ev.repartition("d").write.partitionBy("d").parquet(src)
    J.stream_leaderboard(spark, src, sink, ckpt, files_per_trigger=7).awaitTermination()  # a week per batch
    return spark.read.parquet(sink)


@query("stream_standings")
def q_stream_standings(t):
    """Standings pages arrive in up to ``PAGE_FILES`` files, then an unparsable page per league
    for its latest season; stored snapshots are replaced per season, the bad pages
    leave them untouched."""
    spark = t.spark
    src, store, ckpt = (scratch_path(spark, n) for n in ("pages-in", "standings-store", "standings-ckpt"))
    snap = standings_snapshot(t.matches())
    pages = standings_pages(snap).where(F.col("season") != "notice")
    arrive(pages, src, PAGE_FILES)
    latest = snap.groupBy("league").agg(F.max("season").alias("season"))
    broken = latest.select("league", "season", F.lit("<html><body><p>maintenance</p></body></html>").alias("html"))
    J.stream_standings(spark, src, store, ckpt, files_per_trigger=10).awaitTermination()
    # the late, unparsable pages arrive after that; the restarted stream goes on from the same checkpoint
    arrive(broken, src, LATE_FILES)
    J.stream_standings(spark, src, store, ckpt).awaitTermination()
    return spark.read.schema("team string, played bigint, wins bigint, draws bigint, losses bigint, "
                             "goals_for bigint, goals_against bigint, points bigint, ordinal bigint, "
                             "league bigint, season string").json(store)


@query("stream_elo")
def q_stream_elo(t):
    """Matches arrive season by season, oldest first, each in several files; ratings kept as stream state."""
    spark = t.spark
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))  # all cores write and read a season
    src, sink, ckpt = (scratch_path(spark, n) for n in ("matches-in", "elo", "elo-ckpt"))
    m = t.matches()
    seasons = [r[0] for r in m.select("season_year").distinct().orderBy("season_year").collect()]
    for s in seasons:  # one arrival per season, in season order; the stream resumes from its checkpoint
        m.where(F.col("season_year") == s).repartition(files).write.mode("append").parquet(src)
        J.stream_elo(spark, src, sink, ckpt).awaitTermination()
    return spark.read.parquet(sink)
