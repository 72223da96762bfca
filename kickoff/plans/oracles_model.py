"""Oracle SQL for imputation, median fill, robust scaling and fold bounds."""

from __future__ import annotations

from .oracles import MK, sql
from .oracles_clean import CLEAN, RAW

NUMERIC = ["home_goals", "away_goals", "attendance", "total_goals", "goal_difference"]
PAST = "home_goals IS NOT NULL AND away_goals IS NOT NULL AND result IS NOT NULL"


@sql("impute_median", *RAW)
def _():
    cols = ", ".join(f"ROUND(COALESCE({c}, (SELECT MEDIAN({c}) FROM clean WHERE {PAST})), 6) AS {c}" for c in NUMERIC)
    return CLEAN + f"SELECT {MK}, {cols} FROM clean"


@sql("median_fill", *RAW)
def _():
    cols = ", ".join(f"ROUND(COALESCE({c}, (SELECT MEDIAN({c}) FROM clean)), 6) AS {c}" for c in NUMERIC)
    return CLEAN + f"SELECT {MK}, {cols} FROM clean"


@sql("robust_scale", *RAW)
def _():
    q = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, "
                  f"quantile_cont({c}, 0.75) AS {c}_q3" for c in NUMERIC)
    cols = ", ".join(f"ROUND(({c} - {c}_q2) / CASE WHEN {c}_q3 - {c}_q1 = 0 THEN 1 ELSE {c}_q3 - {c}_q1 END, 6) AS {c}"
                     for c in NUMERIC)
    return CLEAN + f", qs AS (SELECT {q} FROM clean WHERE {PAST})\nSELECT {MK}, {cols} FROM clean, qs"


@sql("time_series_folds", "matches")
def _():
    return """
SELECT league, split, CAST(n - (5 - split) * ts AS BIGINT) AS train_rows, CAST(n - (5 - split) * ts + 1 AS BIGINT) AS test_first,
       CAST(n - (5 - split) * ts + ts AS BIGINT) AS test_last
FROM (SELECT league, COUNT(*) AS n, FLOOR(COUNT(*) / 6) AS ts FROM matches GROUP BY league),
     (SELECT CAST(range AS INTEGER) AS split FROM range(5))
"""


@sql("stratified_folds", "matches")
def _():
    return """
SELECT league, match_date, home_team, away_team, result,
       CAST(NTILE(3) OVER (PARTITION BY result ORDER BY match_date, league, home_team, away_team) - 1 AS INTEGER) AS fold
FROM matches WHERE result IS NOT NULL
"""
