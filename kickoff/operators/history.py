"""Match history operators: team unpivot, league ordinals, the as-of ``hist``.

"As of kick-off" means *strictly earlier date*: matches on the same day never
see each other. All operators here are windows partitioned by at least
(league, team) or by aggregated (league, date) rows, so no task ever holds a
whole league of unaggregated rows and nothing is a self-join on ``date <``.

The ``hist`` trick: ``collect_list`` over a bounded ROWS frame gives, at every
appearance, its last N appearances *including same-day ones*; the value needed
by a row is the ``hist`` of the last appearance on an earlier date, which is
``max_by(hist, rn)`` over ``RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING``
on the day number. Both windows share partitioning and sort order, so Spark
plans one exchange and one sort for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH_KEY = ["league", "match_date", "home_team", "away_team"]


def day_number(c="match_date") -> Column:
    return F.unix_date(F.col(c))


def team_points(result: Column, is_home: Column) -> Column:
    """3/1/0 points of one side from the home-perspective result; null if unplayed."""
    signed = F.when(is_home, result).otherwise(-result)
    return F.when(signed == 1, F.lit(3)).when(signed == 0, F.lit(1)).when(signed == -1, F.lit(0))


def team_unpivot(matches: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per (match, side) in a single scan (explode of a two-element array).

    Columns: the match key, ``team``, ``opponent``, ``is_home``, ``gf``, ``ga``,
    ``points`` (null when unplayed), ``played`` and any ``extra`` match columns.
    """
    extra = [c for c in (extra or []) if c not in MATCH_KEY]
    keep = MATCH_KEY + ["home_goals", "away_goals", "result"] + extra
    m = matches.select(*[F.col(c) for c in dict.fromkeys(keep)])
    sides = F.array(
        F.struct(F.lit(True).alias("is_home"), F.col("home_team").alias("team"),
                 F.col("away_team").alias("opponent"), F.col("home_goals").alias("gf"),
                 F.col("away_goals").alias("ga")),
        F.struct(F.lit(False).alias("is_home"), F.col("away_team").alias("team"),
                 F.col("home_team").alias("opponent"), F.col("away_goals").alias("gf"),
                 F.col("home_goals").alias("ga")),
    )
    out = m.select(*m.columns, F.explode(sides).alias("s")).select(
        *m.columns, "s.is_home", "s.team", "s.opponent", "s.gf", "s.ga")
    return (out.withColumn("points", team_points(F.col("result"), F.col("is_home")))
               .withColumn("played", F.col("result").isNotNull()))


def league_ordinals(matches: DataFrame) -> DataFrame:
    """Add ``g`` (1-based position of the match in its league by order key) and
    ``gb`` (number of league matches on strictly earlier dates).

    Two levels so that a large league is never one window partition of raw
    rows: per-(league, date) counts are prefix-summed over the (small) day
    table, and only the within-day rank is a window on match rows.
    """
    days = matches.groupBy("league", "match_date").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("league").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("league", "match_date",
                       F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint").alias("gb"))
    wd = Window.partitionBy("league", "match_date").orderBy("home_team", "away_team")
    return (matches.join(days, ["league", "match_date"])
                   .withColumn("g", F.col("gb") + F.row_number().over(wd)))


def with_team_history(apps: DataFrame, fields: list[str], depth: int,
                      part: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Attach ``hist``: array of the last ``depth`` entries (oldest first) of the
    same partition on strictly earlier dates, plus ``nb`` = their total count.

    ``fields`` are the columns packed into each history entry. ``part`` defaults
    to (league, team); ``order`` is the total order within a day.
    """
    part = part or ["league", "team"]
    order = order or ["home_team", "away_team"]
    apps = apps.withColumn("_day", day_number())
    w_rows = Window.partitionBy(*part).orderBy("_day", *order)
    w_prev = Window.partitionBy(*part).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    entry = F.struct(*[F.col(f) for f in fields])
    out = (apps
           .withColumn("_rn", F.row_number().over(w_rows))
           .withColumn("_tail", F.collect_list(entry).over(w_rows.rowsBetween(-(depth - 1), 0)))
           .withColumn("nb", F.coalesce(F.count(F.lit(1)).over(w_prev), F.lit(0)))
           .withColumn("hist", F.coalesce(F.max_by("_tail", "_rn").over(w_prev),
                                          F.filter("_tail", lambda x: F.lit(False))))
           .drop("_tail", "_rn", "_day"))
    return out

