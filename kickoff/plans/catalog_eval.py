"""Queries for evaluation operators (2.11) on synthetic scored matches."""

from __future__ import annotations

from ..operators import evaluate as EV
from ..operators.features import league_position
from ..operators.history import MATCH_KEY
from .registry import query


@query("goal_error_metrics")
def q_goal_error(t):
    """MAE, RMSE, R^2 per side and overall MAE."""
    return EV.goal_error_metrics(t.predictions())


@query("tolerance_accuracy")
def q_tolerance(t):
    """Share of goal predictions within 0.5 / 1.0 / 1.5, mean of the sides."""
    return EV.tolerance_accuracy(t.predictions())


@query("error_by_score_band")
def q_error_band(t):
    """Mean summed absolute goal error by band of actual total goals."""
    return EV.error_by_score_band(t.predictions())


@query("error_histogram")
def q_error_histogram(t):
    """20-bin histogram of absolute goal errors per side."""
    return EV.error_histogram(t.predictions())


@query("classification_metrics")
def q_classification(t):
    """Accuracy, per-class precision / recall / F1 / support, macro means."""
    return EV.classification_metrics(t.predictions())


@query("log_loss")
def q_log_loss(t):
    """Mean negative log probability of the actual class."""
    return EV.log_loss(t.predictions())


@query("confusion_matrix")
def q_confusion(t):
    """Actual x predicted counts with row percentages."""
    return EV.confusion_matrix(t.predictions())


@query("confidence_bins")
def q_confidence_bins(t):
    """Accuracy and count by band of the maximum class probability."""
    return EV.confidence_bins(t.predictions())


@query("confidence_histogram")
def q_confidence_histogram(t):
    """20-bin density of the maximum probability, correct vs incorrect."""
    return EV.confidence_histogram(t.predictions())


@query("calibration_curve")
def q_calibration(t):
    """Seven 0.1-wide bins on [0.3, 1.0): centre and accuracy (0 when empty)."""
    return EV.calibration_curve(t.predictions())


@query("perf_by_season")
def q_perf_season(t):
    """Goal MAE (mean of sides) and result accuracy per season."""
    return EV.perf_by_season(t.predictions())


@query("perf_by_strength")
def q_perf_strength(t):
    """Goal MAE and accuracy by league-position gap band (positions as of kick-off)."""
    # scored where the positions are found, by (league, season): nothing is joined on the match key
    placed = league_position(t.matches(), ("season_year", "home_goals", "away_goals", "result"))
    return EV.perf_by_strength(t.predictions(placed.dropna(subset=MATCH_KEY)))


@query("perf_by_weekend")
def q_perf_weekend(t):
    """Goal MAE and accuracy, weekend vs weekday."""
    return EV.perf_by_weekend(t.predictions())


@query("perf_by_scoring")
def q_perf_scoring(t):
    """Accuracy above vs at-or-below the median total goals."""
    return EV.perf_by_scoring(t.predictions())


@query("best_season")
def q_best_season(t):
    """Season with the lowest goal MAE and with the highest accuracy."""
    return EV.best_season(t.predictions())


@query("detailed_predictions")
def q_detailed(t):
    """Scored matches with predictions and prob_<class> columns."""
    return EV.detailed_predictions(t.predictions())


@query("actual_vs_pred")
def q_actual_vs_pred(t):
    """Aggregated scatter inputs: actual vs predicted goals, total goals vs error."""
    return EV.actual_vs_pred(t.predictions())


@query("eval_report")
def q_eval_report(t):
    """All evaluation metrics as one long (section, metric, value) table."""
    return EV.eval_report(t.predictions())
