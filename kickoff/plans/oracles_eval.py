"""Oracle SQL for the evaluation operators."""

from __future__ import annotations

from ..operators.evaluate import calibration_edges
from .oracles import MK, ORACLES, sql
from .oracles_clean import RAW  # noqa: F401
from .oracles import ASOF_TABLE

P = "predictions"
ERR = "(SELECT *, home_goals - pred_home_goals AS eh, away_goals - pred_away_goals AS ea FROM predictions)"
R = "ROUND(CAST({} AS DOUBLE), 6)"


@sql("goal_error_metrics", P)
def _():
    return f"""
SELECT ROUND(AVG(ABS(eh)), 6) AS mae_home, ROUND(AVG(ABS(ea)), 6) AS mae_away,
       ROUND((AVG(ABS(eh)) + AVG(ABS(ea))) / 2, 6) AS mae_overall,
       ROUND(SQRT(AVG(eh * eh)), 6) AS rmse_home, ROUND(SQRT(AVG(ea * ea)), 6) AS rmse_away,
       ROUND(1 - SUM(eh * eh) / SUM((home_goals - mh) * (home_goals - mh)), 6) AS r2_home,
       ROUND(1 - SUM(ea * ea) / SUM((away_goals - ma) * (away_goals - ma)), 6) AS r2_away
FROM (SELECT *, AVG(home_goals) OVER () AS mh, AVG(away_goals) OVER () AS ma FROM {ERR})
"""


@sql("tolerance_accuracy", P)
def _():
    parts = [f"SELECT {t} AS tolerance, ROUND((AVG(CASE WHEN ABS(eh) <= {t} THEN 1.0 ELSE 0.0 END) + "
             f"AVG(CASE WHEN ABS(ea) <= {t} THEN 1.0 ELSE 0.0 END)) / 2, 6) AS accuracy FROM {ERR}"
             for t in ("0.5", "1.0", "1.5")]
    return "SELECT CAST(tolerance AS DOUBLE) AS tolerance, accuracy FROM (" + " UNION ALL ".join(parts) + ")"


@sql("error_by_score_band", P)
def _():
    return f"""
SELECT band, ROUND(AVG(ABS(eh) + ABS(ea)), 6) AS avg_error, COUNT(*) AS matches
FROM (SELECT *, CASE WHEN tot BETWEEN 0 AND 1 THEN '0-1' WHEN tot BETWEEN 2 AND 3 THEN '2-3'
                     WHEN tot BETWEEN 4 AND 5 THEN '4-5' WHEN tot BETWEEN 6 AND 20 THEN '6-20' END AS band
      FROM (SELECT *, home_goals + away_goals AS tot FROM {ERR}))
WHERE band IS NOT NULL GROUP BY band
"""


def _hist(src: str, value: str, group: str, density: bool) -> str:
    dens = (", ROUND(CAST(COALESCE(c.cnt, 0) AS DOUBLE) / (r.n * ((r.hi - r.lo) / 20)), 6) AS density"
            if density else "")
    return f"""
WITH src AS ({src}),
r AS (SELECT {group}, CASE WHEN MAX({value}) > MIN({value}) THEN MIN({value}) ELSE MIN({value}) - 0.5 END AS lo,
             CASE WHEN MAX({value}) > MIN({value}) THEN MAX({value}) ELSE MAX({value}) + 0.5 END AS hi,
             COUNT({value}) AS n FROM src GROUP BY {group}),
c AS (SELECT s.{group}, CAST(LEAST(FLOOR((s.{value} - r.lo) * (20.0 / (r.hi - r.lo))), 19) AS INTEGER) AS bin, COUNT(*) AS cnt
      FROM src s JOIN r USING ({group}) WHERE s.{value} IS NOT NULL GROUP BY ALL),
g AS (SELECT r.*, b.bin FROM r JOIN (SELECT CAST(range AS INTEGER) AS bin, 1 AS k FROM range(20)) b ON TRUE)
SELECT g.{group}, g.bin, ROUND(g.lo + g.bin * ((g.hi - g.lo) / 20), 6) AS bin_lo, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count
       {dens.replace('r.', 'g.')}
FROM g LEFT JOIN c ON c.{group} = g.{group} AND c.bin = g.bin
"""


@sql("error_histogram")
def _():
    from ..fixtures import oracle_with
    src = (oracle_with(P) + f"SELECT 'home' AS side, ABS(eh) AS abs_error FROM {ERR} "
           f"UNION ALL SELECT 'away', ABS(ea) FROM {ERR}")
    return _hist(src, "abs_error", "side", False)


@sql("classification_metrics", P)
def _():
    return """,
cm AS (SELECT result AS actual, pred_result AS predicted, COUNT(*) AS n FROM predictions GROUP BY ALL),
lab AS (SELECT actual AS label FROM cm UNION SELECT predicted FROM cm),
t AS (
  SELECT label, COALESCE((SELECT SUM(n) FROM cm WHERE actual = label), 0) AS support,
         COALESCE((SELECT SUM(n) FROM cm WHERE actual = label AND predicted = label), 0) AS tp,
         COALESCE((SELECT SUM(n) FROM cm WHERE predicted = label), 0) AS predicted_n FROM lab),
m AS (SELECT *, CASE WHEN predicted_n > 0 THEN tp / predicted_n ELSE 0.0 END AS prec,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM t),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m)
SELECT CASE label WHEN 1 THEN 'Home Win' WHEN 0 THEN 'Draw' WHEN -1 THEN 'Away Win' END AS class_name,
       ROUND(prec, 6) AS precision, ROUND(rec, 6) AS recall, ROUND(f1, 6) AS f1, CAST(support AS BIGINT) AS support,
       ROUND(SUM(tp) OVER () / SUM(support) OVER (), 6) AS accuracy,
       ROUND(AVG(prec) OVER (), 6) AS macro_precision, ROUND(AVG(rec) OVER (), 6) AS macro_recall,
       ROUND(AVG(f1) OVER (), 6) AS macro_f1
FROM f
"""


@sql("log_loss", P)
def _():
    eps = repr(2.220446049250313e-16)
    return f"""
SELECT ROUND(AVG(-LN(LEAST(GREATEST(p, {eps}), 1 - {eps}))), 6) AS log_loss
FROM (SELECT result, CASE result WHEN 1 THEN prob_home WHEN 0 THEN prob_draw WHEN -1 THEN prob_away END AS p
      FROM predictions WHERE result IS NOT NULL)
HAVING COUNT(DISTINCT result) = 3
"""


@sql("confusion_matrix", P)
def _():
    return """
SELECT actual, a AS pred_away, d AS pred_draw, h AS pred_home,
       ROUND(a / (a + d + h), 6) AS pct_away, ROUND(d / (a + d + h), 6) AS pct_draw, ROUND(h / (a + d + h), 6) AS pct_home
FROM (SELECT result AS actual, COUNT(*) FILTER (WHERE pred_result = -1) AS a, COUNT(*) FILTER (WHERE pred_result = 0) AS d,
             COUNT(*) FILTER (WHERE pred_result = 1) AS h FROM predictions GROUP BY result)
"""


MAXP = "(SELECT *, GREATEST(prob_away, prob_draw, prob_home) AS max_prob, result = pred_result AS correct FROM predictions)"


@sql("confidence_bins", P)
def _():
    return f"""
SELECT bin, ROUND(AVG(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy, COUNT(*) AS predictions
FROM (SELECT *, CASE WHEN max_prob >= 0.4 AND max_prob < 0.6 THEN '0.4-0.6' WHEN max_prob >= 0.6 AND max_prob < 0.8 THEN '0.6-0.8'
                     WHEN max_prob >= 0.8 AND max_prob < 0.9 THEN '0.8-0.9' WHEN max_prob >= 0.9 AND max_prob < 1.0 THEN '0.9-1.0' END AS bin
      FROM {MAXP})
WHERE bin IS NOT NULL GROUP BY bin
"""


@sql("confidence_histogram")
def _():
    from ..fixtures import oracle_with
    src = oracle_with(P) + f"SELECT CASE WHEN correct THEN 'correct' ELSE 'incorrect' END AS \"group\", max_prob FROM {MAXP}"
    return _hist(src, "max_prob", '"group"', True)


@sql("calibration_curve", P)
def _():
    e = calibration_edges()
    lit = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    bins = " ".join(f"WHEN max_prob >= {lit(e[k])} AND max_prob < {lit(e[k + 1])} THEN {k}" for k in range(7))
    grid = " UNION ALL ".join(f"SELECT {k} AS bin, {lit((e[k] + e[k + 1]) / 2)} AS centre" for k in range(7))
    return f""",
a AS (SELECT bin, AVG(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS acc, COUNT(*) AS n
      FROM (SELECT *, CASE {bins} END AS bin FROM {MAXP}) WHERE bin IS NOT NULL GROUP BY bin)
SELECT g.bin, ROUND(g.centre, 6) AS centre, ROUND(COALESCE(a.acc, 0.0), 6) AS accuracy,
       CAST(COALESCE(a.n, 0) AS BIGINT) AS predictions
FROM ({grid}) g LEFT JOIN a USING (bin)
"""


def _perf(key: str, src: str = ERR) -> str:
    return f"""
SELECT {key}, ROUND((AVG(ABS(eh)) + AVG(ABS(ea))) / 2, 6) AS goal_mae,
       ROUND(AVG(CASE WHEN result = pred_result THEN 1.0 ELSE 0.0 END), 6) AS result_accuracy, COUNT(*) AS matches
FROM {src} GROUP BY 1
"""


@sql("perf_by_season", P)
def _():
    return _perf("season_year")


@sql("perf_by_strength", P)
def _():
    src = f"""(SELECT e.*, CASE WHEN gap <= 3 THEN 'Close (0-3 positions)' WHEN gap <= 8 THEN 'Medium (4-8 positions)'
                     ELSE 'Large (>8 positions)' END AS strength
       FROM (SELECT e.*, ABS(COALESCE(h.position, 10) - COALESCE(a.position, 10)) AS gap FROM {ERR} e
             LEFT JOIN ranked h ON h.league = e.league AND h.season_year = e.season_year AND h.as_of = e.match_date AND h.team = e.home_team
             LEFT JOIN ranked a ON a.league = e.league AND a.season_year = e.season_year AND a.as_of = e.match_date AND a.team = e.away_team) e)"""
    return ASOF_TABLE + _perf("strength", src)


@sql("perf_by_weekend", P)
def _():
    return _perf("CASE WHEN ISODOW(match_date) IN (6, 7) THEN 'Weekend' ELSE 'Weekday' END AS match_type")


@sql("perf_by_scoring", P)
def _():
    return """
SELECT CASE WHEN home_goals + away_goals > (SELECT MEDIAN(home_goals + away_goals) FROM predictions)
            THEN 'High Scoring' ELSE 'Low Scoring' END AS match_type,
       ROUND(AVG(CASE WHEN result = pred_result THEN 1.0 ELSE 0.0 END), 6) AS result_accuracy, COUNT(*) AS matches
FROM predictions GROUP BY 1
"""


@sql("best_season", P)
def _():
    return f""",
s AS ({_perf("season_year")})
SELECT (SELECT season_year FROM s ORDER BY goal_mae, season_year LIMIT 1) AS best_goal_season,
       (SELECT MIN(goal_mae) FROM s) AS best_goal_mae,
       (SELECT season_year FROM s ORDER BY result_accuracy DESC, season_year LIMIT 1) AS best_result_season,
       (SELECT MAX(result_accuracy) FROM s) AS best_result_accuracy
"""


@sql("detailed_predictions", P)
def _():
    return f"""
SELECT {MK}, home_goals, away_goals, venue, result, season_year, ROUND(pred_home_goals, 6) AS pred_home_goals,
       ROUND(pred_away_goals, 6) AS pred_away_goals, pred_result, ROUND(prob_away, 6) AS "prob_-1",
       ROUND(prob_draw, 6) AS prob_0, ROUND(prob_home, 6) AS prob_1
FROM predictions
"""


@sql("actual_vs_pred", P)
def _():
    return f"""
SELECT series, ROUND(x, 6) AS x, ROUND(y, 6) AS y, COUNT(*) AS points FROM (
  SELECT 'home' AS series, home_goals AS x, pred_home_goals AS y FROM {ERR}
  UNION ALL SELECT 'away', away_goals, pred_away_goals FROM {ERR}
  UNION ALL SELECT 'total_error', home_goals + away_goals, ABS(eh) + ABS(ea) FROM {ERR})
GROUP BY ALL
"""


@sql("eval_report", P)
def _():
    rows = []

    def take(name: str, section: str, pairs: list[tuple[str, str]], tail: str = "") -> None:
        rows.extend(f"SELECT '{section}' AS section, {metric} AS metric, CAST({value} AS DOUBLE) AS value FROM ({ORACLES[name]}){tail}" for metric, value in pairs)

    take("goal_error_metrics", "goal_prediction", [(f"'{c}'", c) for c in ("mae_home", "mae_away", "mae_overall", "rmse_home", "rmse_away", "r2_home", "r2_away")])
    take("tolerance_accuracy", "goal_prediction", [("'accuracy_within_' || CAST(tolerance AS VARCHAR)", "accuracy")])
    take("classification_metrics", "result_prediction", [(f"LOWER(class_name) || '_{c}'", c) for c in ("precision", "recall", "f1")])
    take("classification_metrics", "result_prediction", [(f"'{c}'", c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")], " WHERE class_name = 'Draw'")
    take("log_loss", "result_prediction", [("'log_loss'", "log_loss")])
    take("perf_by_season", "season_performance", [("CAST(season_year AS VARCHAR)", "goal_mae")])
    take("perf_by_season", "season_accuracy", [("CAST(season_year AS VARCHAR)", "result_accuracy")])
    return "SELECT 'dataset' AS section, 'dataset_size' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM predictions UNION ALL " + " UNION ALL ".join(rows)


ORACLES["sink_eval_report"] = ORACLES["eval_report"]
