"""Cleaning: projections and filters that turn a raw match table into a clean one.

Every step is a narrow, column-wise transformation (whole-stage codegen, no
shuffle) except the alias lookup, which joins a user alias table that is
broadcast only after its size is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from .joins import join_small


def _map_lit(d: dict):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def canon_team_names(df: DataFrame, aliases: DataFrame | None = None,
                     cols=("home_team", "away_team")) -> DataFrame:
    """Whole-value alias mapping of team names, applied before trimming.

    The fixed alias dictionary is a map literal; an optional user table
    ``(alias, canonical)`` is left-joined per column (broadcast when small).
    Mapping does not cascade: each value is looked up once.
    """
    fixed = _map_lit(C.TEAM_ALIASES)
    out = df
    for c in cols:
        mapped = F.coalesce(F.try_element_at(fixed, F.col(c)), F.col(c))
        if aliases is not None:
            a = aliases.select(F.col("alias").alias(f"_alias_{c}"), F.col("canonical").alias(f"_canon_{c}"))
            out = join_small(out, a, F.col(c) == F.col(f"_alias_{c}"), "left")
            mapped = F.coalesce(F.col(f"_canon_{c}"), F.try_element_at(fixed, F.col(c)), F.col(c))
            out = out.withColumn(c, mapped).drop(f"_alias_{c}", f"_canon_{c}")
        else:
            out = out.withColumn(c, mapped)
    return out


def trim_team_names(df: DataFrame, cols=("home_team", "away_team")) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, S.strip_ws(c))
    return df


def parse_match_date(df: DataFrame, src: str = "date", out: str = "match_date") -> DataFrame:
    """ISO date text -> DATE; anything else -> null."""
    return df.withColumn(out, F.to_date(F.try_to_timestamp(F.col(src), F.lit("yyyy-MM-dd"))))


def calendar_parts(df: DataFrame, date_col: str = "match_date") -> DataFrame:
    d = F.col(date_col)
    return (df.withColumn("year", F.year(d)).withColumn("month", F.month(d))
              .withColumn("day_of_week", F.weekday(d))
              .withColumn("is_weekend", F.coalesce(F.weekday(d).isin(5, 6), F.lit(False)).cast("int")))


def add_season_year(df: DataFrame, date_col: str = "match_date") -> DataFrame:
    return df.withColumn("season_year", S.season_of(date_col))


def clean_scores(df: DataFrame) -> DataFrame:
    """Goals to numbers; below 0 or above 10 -> null, each side on its own."""
    return (df.withColumn("home_goals", S.clean_goals("home_goals"))
              .withColumn("away_goals", S.clean_goals("away_goals")))


def encode_result(df: DataFrame) -> DataFrame:
    return df.withColumn("result", S.encode_result("home_goals", "away_goals"))


def clean_venue(df: DataFrame) -> DataFrame:
    """Strip, null -> Unknown, fixed aliases; no venue column -> '<home> Stadium'."""
    if "venue" not in df.columns:
        return df.withColumn("venue", F.concat(F.col("home_team"), F.lit(C.VENUE_SUFFIX)))
    v = F.coalesce(S.strip_ws("venue"), F.lit(C.UNKNOWN_VENUE))
    return df.withColumn("venue", F.coalesce(F.try_element_at(_map_lit(C.VENUE_ALIASES), v), v))


def clean_attendance(df: DataFrame) -> DataFrame:
    if "attendance" not in df.columns:
        return df
    return df.withColumn("attendance", S.clean_attendance("attendance"))


def derived_goals(df: DataFrame) -> DataFrame:
    return (df.withColumn("total_goals", F.col("home_goals") + F.col("away_goals"))
              .withColumn("goal_difference", F.col("home_goals") - F.col("away_goals")))


def match_flags(df: DataFrame) -> DataFrame:
    """high/low scoring, competitive, midweek as 0/1; unknown -> 0 (midweek: unknown day -> 1)."""
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    return (df.withColumn("high_scoring", flag(F.col("total_goals") > 3))
              .withColumn("low_scoring", flag(F.col("total_goals") < 2))
              .withColumn("competitive", flag(F.abs(F.col("goal_difference")) <= 1))
              .withColumn("is_midweek", flag(~F.coalesce(F.col("day_of_week").isin(5, 6), F.lit(False))))
              .withColumn("month_category", S.month_category("month")))


def drop_invalid_matches(df: DataFrame, date_col: str = "match_date") -> DataFrame:
    """Remove null teams, self-matches and null dates (sorting is left to the output)."""
    return df.na.drop(subset=["home_team", "away_team"]).where(
        (F.col("home_team") != F.col("away_team")) & F.col(date_col).isNotNull())


def drop_invalid_counted(df: DataFrame, path: str, date_col: str = "match_date") -> dict[str, int]:
    """Writes the rows that ``drop_invalid_matches`` keeps to ``path`` and returns how many rows
    were read, kept and removed: counted as they pass, in the write's one scan."""
    read, kept = Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    drop_invalid_matches(df.observe(read, count), date_col).observe(kept, count).write.mode("overwrite").parquet(path)
    n, m = read.get["n"], kept.get["n"]
    return {"rows_read": n, "rows_kept": m, "rows_removed": n - m}


def drop_columns(df: DataFrame, cols=C.DROPPED_COLUMNS) -> DataFrame:
    """Tolerant drop: names that are not present are ignored."""
    return df.drop(*cols)


def select_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def filter_scraped_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a team name missing or shorter than 2, or equal to a header word."""
    h, a = F.col("home_team"), F.col("away_team")
    ok = (h.isNotNull() & a.isNotNull() & (F.length(h) >= 2) & (F.length(a) >= 2)
          & ~F.lower(h).isin(*C.HOME_HEADER_WORDS) & ~F.lower(a).isin(*C.AWAY_HEADER_WORDS))
    return df.where(ok)


def preprocess(raw: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The full cleaning pipeline in the reference's order (lazy, one narrow stage
    plus the optional alias join)."""
    return match_flags(derived_goals(drop_invalid_matches(before_drop(raw, aliases))))


def before_drop(raw: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The cleaning steps up to the removal of invalid rows."""
    df = canon_team_names(raw, aliases)
    df = trim_team_names(df)
    df = parse_match_date(df)
    df = calendar_parts(df)
    df = add_season_year(df)
    df = clean_scores(df)
    df = encode_result(df)
    df = clean_venue(df)
    return clean_attendance(df)


def split_past_future(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Past = both goals and result known; the rest are fixtures to score."""
    known = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull() & F.col("result").isNotNull()
    return df.where(known), df.where(~known)


def find_duplicates(df: DataFrame, keys=("match_date", "home_team", "away_team")) -> DataFrame:
    """Rows repeating their key after the first (null keys compare equal)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return counts.where(F.col("copies") > 1).withColumn("extra_rows", F.col("copies") - 1)


def time_split(df: DataFrame, fraction: float = C.TRAIN_FRACTION) -> DataFrame:
    """Past matches, the first floor(fraction * n) of each league by order key flagged as train.

    Unplayed matches are neither trained nor tested on and take no part in the split.
    """
    from .history import league_ordinals
    df, _ = split_past_future(df)
    n = df.groupBy("league").agg(F.count(F.lit(1)).alias("_n"))
    o = league_ordinals(df).join(n, "league")
    return o.withColumn("is_train", F.col("g") <= F.floor(F.col("_n") * F.lit(fraction))).drop("_n", "gb")


def season_filter(df: DataFrame, season) -> DataFrame:
    return df.where(F.col("season") == F.lit(season))


def sort_by_date(df: DataFrame) -> DataFrame:
    """Chronological order by the total order key (range-partitioned sort)."""
    return df.orderBy("league", "match_date", "home_team", "away_team")
