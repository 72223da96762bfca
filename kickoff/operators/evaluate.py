"""Evaluation of scored matches: error, classification, confidence, calibration.

Input: a scored-match table with actual ``home_goals``, ``away_goals``,
``result`` (1/0/-1), predictions ``pred_home_goals``, ``pred_away_goals``,
``pred_result`` and class probabilities ``prob_away``, ``prob_draw``,
``prob_home`` (classes -1, 0, 1). Every metric is one distributed
aggregation; windows only run over the handful of aggregated rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..session import materialize

CLASSES = [(-1, "Away Win", "prob_away"), (0, "Draw", "prob_draw"), (1, "Home Win", "prob_home")]
EPS = float(np.finfo(float).eps)  # probability clip used by log loss


def _err(df: DataFrame) -> DataFrame:
    return df.select("*", (F.col("home_goals") - F.col("pred_home_goals")).alias("_eh"),
                     (F.col("away_goals") - F.col("pred_away_goals")).alias("_ea"))


def goal_error_metrics(df: DataFrame) -> DataFrame:
    """MAE, RMSE and R^2 per side; overall MAE = mean of the two."""
    e = _err(df)
    out = e.agg(
        F.avg(F.abs("_eh")).alias("mae_home"), F.avg(F.abs("_ea")).alias("mae_away"),
        F.sqrt(F.avg(F.col("_eh") ** 2)).alias("rmse_home"), F.sqrt(F.avg(F.col("_ea") ** 2)).alias("rmse_away"),
        F.sum(F.col("_eh") ** 2).alias("_ssr_h"), F.sum(F.col("_ea") ** 2).alias("_ssr_a"),
        (F.var_pop("home_goals") * F.count(F.lit(1))).alias("_sst_h"),
        (F.var_pop("away_goals") * F.count(F.lit(1))).alias("_sst_a"))
    r2 = lambda ssr, sst: F.when(F.col(sst) > 0, 1 - F.col(ssr) / F.col(sst))
    return out.select("mae_home", "mae_away", ((F.col("mae_home") + F.col("mae_away")) / 2).alias("mae_overall"),
                      "rmse_home", "rmse_away", r2("_ssr_h", "_sst_h").alias("r2_home"),
                      r2("_ssr_a", "_sst_a").alias("r2_away"))


def tolerance_accuracy(df: DataFrame, tolerances=C.TOLERANCES) -> DataFrame:
    """Share of predictions within each tolerance, averaged over the two sides."""
    e = _err(df)
    aggs = []
    for i, tol in enumerate(tolerances):
        aggs.append(((F.avg((F.abs("_eh") <= tol).cast("double")) + F.avg((F.abs("_ea") <= tol).cast("double"))) / 2)
                    .alias(f"t{i}"))
    wide = e.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(float(tol)).alias("tolerance"), F.col(f"t{i}").alias("accuracy"))
        for i, tol in enumerate(tolerances)])).alias("kv")).select("kv.*")


def error_by_score_band(df: DataFrame, bands=C.SCORE_BANDS) -> DataFrame:
    """Mean summed absolute error by band of actual total goals; empty bands omitted."""
    e = _err(df).withColumn("_tot", F.col("home_goals") + F.col("away_goals"))
    band = None
    for lo, hi in bands:
        cond = (F.col("_tot") >= lo) & (F.col("_tot") <= hi)
        lab = F.lit(f"{lo}-{hi}")
        band = F.when(cond, lab) if band is None else band.when(cond, lab)
    return (e.withColumn("band", band).where(F.col("band").isNotNull())
            .groupBy("band").agg(F.avg(F.abs("_eh") + F.abs("_ea")).alias("avg_error"),
                                 F.count(F.lit(1)).alias("matches")))


def histogram(df: DataFrame, value: str, group: str | None = None, bins: int = C.HIST_BINS,
              density: bool = False) -> DataFrame:
    """Equal-width histogram over each group's own [min, max]; the top edge falls in
    the last bin; a constant column spans [v - 0.5, v + 0.5]. All ``bins`` bins are
    returned (empty ones with 0)."""
    if group is None:
        df, group = df.withColumn("_all", F.lit(0)), "_all"
    keys = [group]
    rng = df.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"), F.count(value).alias("_n"))
    rng = (rng.withColumn("_lo", F.when(F.col("_mx") > F.col("_mn"), F.col("_mn")).otherwise(F.col("_mn") - 0.5))
              .withColumn("_hi", F.when(F.col("_mx") > F.col("_mn"), F.col("_mx")).otherwise(F.col("_mx") + 0.5)))
    # one row per group: bounded by the number of groups, safe to broadcast
    joined = df.select(*keys, value).where(F.col(value).isNotNull()).join(F.broadcast(rng), keys)
    idx = F.least(F.floor((F.col(value) - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))),
                  F.lit(bins - 1)).cast("int")
    counts = joined.groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*keys, "_lo", "_hi", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    out = grid.join(counts, keys + ["bin"], "left").select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "_n", width.alias("_w"))
    if density:
        out = out.withColumn("density", F.col("count") / (F.col("_n") * F.col("_w")))
    return out.drop("_n", "_w")


def error_histogram(df: DataFrame, bins: int = C.HIST_BINS) -> DataFrame:
    """20 equal-width bins of the absolute error, per side."""
    e = _err(df)
    long = e.select(F.explode(F.array(
        F.struct(F.lit("home").alias("side"), F.abs("_eh").alias("abs_error")),
        F.struct(F.lit("away").alias("side"), F.abs("_ea").alias("abs_error")))).alias("s")).select("s.*")
    return histogram(long, "abs_error", "side", bins)


def _confusion(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("result").alias("actual"), F.col("pred_result").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame) -> DataFrame:
    """Per class (of actual or predicted labels): precision, recall, F1, support;
    with accuracy and macro means on every row. Undefined ratios -> 0."""
    return _per_class(_confusion(df))


def _per_class(cm: DataFrame) -> DataFrame:
    """``classification_metrics`` of confusion counts (actual, predicted, n)."""
    per_actual = cm.groupBy(F.col("actual").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("tp"))
    per_pred = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    t = per_actual.join(per_pred, "label", "full").na.fill(0, ["support", "tp", "predicted_n"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    t = t.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                   F.col("precision") + F.col("recall")), F.lit(0.0)))
    w = Window.partitionBy()  # <= 3 rows
    name = F.when(F.col("label") == 1, "Home Win").when(F.col("label") == 0, "Draw").when(F.col("label") == -1, "Away Win")
    return t.select(
        name.alias("class_name"), "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"),
        (F.sum("tp").over(w) / F.sum("support").over(w)).alias("accuracy"),
        F.avg("precision").over(w).alias("macro_precision"), F.avg("recall").over(w).alias("macro_recall"),
        F.avg("f1").over(w).alias("macro_f1"))


def _clipped_p():
    """Probability of the actual class, clipped to [eps, 1 - eps]."""
    p_true = F.when(F.col("result") == 1, F.col("prob_home")).when(F.col("result") == 0, F.col("prob_draw")) \
        .when(F.col("result") == -1, F.col("prob_away"))
    return F.least(F.greatest(p_true, F.lit(EPS)), F.lit(1 - EPS))


def log_loss(df: DataFrame) -> DataFrame:
    """Mean -ln p(actual class), p clipped to [eps, 1 - eps]; no row when a class is
    absent from the actual results (the metric is undefined there)."""
    agg = df.where(F.col("result").isNotNull()).agg(
        F.avg(-F.ln(_clipped_p())).alias("log_loss"), F.count_distinct("result").alias("_classes"))
    return agg.where(F.col("_classes") == len(CLASSES)).select("log_loss")


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Counts actual x predicted (pivot on the three classes) and row percentages."""
    wide = (df.groupBy(F.col("result").alias("actual"))
              .pivot("pred_result", [-1, 0, 1]).agg(F.count(F.lit(1))).na.fill(0))
    wide = wide.select("actual", *[F.col(f"`{k}`").cast("bigint").alias(f"pred_{n}") for k, n in
                                   ((-1, "away"), (0, "draw"), (1, "home"))])
    total = F.col("pred_away") + F.col("pred_draw") + F.col("pred_home")
    return wide.select("*", *[(F.col(f"pred_{n}") / total).alias(f"pct_{n}") for n in ("away", "draw", "home")])


def _max_prob(df: DataFrame) -> DataFrame:
    return df.select("*", F.greatest("prob_away", "prob_draw", "prob_home").alias("max_prob"),
                     (F.col("result") == F.col("pred_result")).alias("correct"))


def confidence_bins(df: DataFrame, bins=C.CONFIDENCE_BINS) -> DataFrame:
    """Accuracy and count for max probability in [.4,.6) [.6,.8) [.8,.9) [.9,1.0); empty bins omitted."""
    m = _max_prob(df)
    b = None
    for lo, hi in bins:
        cond = (F.col("max_prob") >= lo) & (F.col("max_prob") < hi)
        lab = F.lit(f"{lo:.1f}-{hi:.1f}")
        b = F.when(cond, lab) if b is None else b.when(cond, lab)
    return (m.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy("bin")
            .agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("predictions")))


def confidence_histogram(df: DataFrame, bins: int = C.HIST_BINS) -> DataFrame:
    """Density histogram of the max probability, correct vs incorrect predictions."""
    m = _max_prob(df).select(F.when(F.col("correct"), "correct").otherwise("incorrect").alias("group"), "max_prob")
    return histogram(m, "max_prob", "group", bins, density=True)


def calibration_edges() -> list[float]:
    """Bin edges: 8 evenly spaced points from 0.3 to 1.0 (numpy's linspace rule)."""
    return [float(x) for x in np.linspace(0.3, 1.0, 8)]


def calibration_curve(df: DataFrame) -> DataFrame:
    """Seven bins on [0.3, 1.0): centre and accuracy (0 when empty)."""
    edges = calibration_edges()
    m = _max_prob(df)
    b = None
    for k in range(len(edges) - 1):
        cond = (F.col("max_prob") >= F.lit(edges[k])) & (F.col("max_prob") < F.lit(edges[k + 1]))
        b = F.when(cond, F.lit(k)) if b is None else b.when(cond, F.lit(k))
    acc = m.withColumn("bin", b).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("predictions"))
    centres = [(edges[k] + edges[k + 1]) / 2 for k in range(len(edges) - 1)]
    grid = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(centres)], "bin int, centre double")
    return grid.join(acc, "bin", "left").select(
        "bin", "centre", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("predictions", F.lit(0)).cast("bigint").alias("predictions"))


def _perf(df: DataFrame, key) -> DataFrame:
    e = _err(df)
    return e.groupBy(key).agg(
        ((F.avg(F.abs("_eh")) + F.avg(F.abs("_ea"))) / 2).alias("goal_mae"),
        F.avg((F.col("result") == F.col("pred_result")).cast("double")).alias("result_accuracy"),
        F.count(F.lit(1)).alias("matches"))


def perf_by_season(df: DataFrame) -> DataFrame:
    return _perf(df, F.col("season_year"))


def perf_by_strength(df: DataFrame) -> DataFrame:
    """By |home position - away position|: <= 3, 4..8, > 8 (needs the position features)."""
    gap = F.abs(F.col("home_league_position") - F.col("away_league_position"))
    band = None
    for name, lo, hi in C.STRENGTH_BANDS:
        cond = (gap >= lo) if hi is None else ((gap >= lo) & (gap <= hi))
        band = F.when(cond, F.lit(name)) if band is None else band.when(cond, F.lit(name))
    return _perf(df, band.alias("strength"))


def perf_by_weekend(df: DataFrame) -> DataFrame:
    wk = F.weekday("match_date").isin(5, 6)
    return _perf(df, F.when(wk, C.WEEKEND_LABELS[1]).otherwise(C.WEEKEND_LABELS[0]).alias("match_type"))


def perf_by_scoring(df: DataFrame) -> DataFrame:
    """Accuracy above vs at-or-below the median total goals."""
    tot = F.col("home_goals") + F.col("away_goals")
    med = df.agg(F.median(tot)).first()[0]  # one number (exact median; few distinct totals)
    hi, lo = C.SCORING_LABELS
    return (df.withColumn("match_type", F.when(tot > F.lit(med), hi).otherwise(lo))
             .groupBy("match_type").agg(
                 F.avg((F.col("result") == F.col("pred_result")).cast("double")).alias("result_accuracy"),
                 F.count(F.lit(1)).alias("matches")))


def best_season(df: DataFrame) -> DataFrame:
    """Season with the lowest goal MAE and season with the highest accuracy (first wins a tie)."""
    p = perf_by_season(df)
    return p.agg(F.min_by("season_year", F.struct("goal_mae", "season_year")).alias("best_goal_season"),
                 F.min("goal_mae").alias("best_goal_mae"),
                 F.min_by("season_year", F.struct(-F.col("result_accuracy"), F.col("season_year")))
                  .alias("best_result_season"),
                 F.max("result_accuracy").alias("best_result_accuracy"))


def detailed_predictions(df: DataFrame) -> DataFrame:
    """Match rows with predictions and one ``prob_<class>`` column per class label."""
    base = [c for c in df.columns if c not in ("prob_away", "prob_draw", "prob_home", "wh", "wd", "wa")]
    return df.select(*base, *[F.col(p).alias(f"prob_{k}") for k, _, p in CLASSES])


def actual_vs_pred(df: DataFrame) -> DataFrame:
    """Scatter inputs aggregated: (side, actual, predicted) counts and (total goals, total error) counts.

    Coordinates are rounded to 6 decimals before grouping so float noise in
    summed errors does not split one scatter point into several."""
    e = _err(df)
    pairs = e.select(F.explode(F.array(
        F.struct(F.lit("home").alias("series"), F.col("home_goals").alias("x"), F.col("pred_home_goals").alias("y")),
        F.struct(F.lit("away").alias("series"), F.col("away_goals").alias("x"), F.col("pred_away_goals").alias("y")),
        F.struct(F.lit("total_error").alias("series"), (F.col("home_goals") + F.col("away_goals")).alias("x"),
                 (F.abs("_eh") + F.abs("_ea")).alias("y")))).alias("p")).select("p.*")
    return (pairs.select("series", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
            .groupBy("series", "x", "y").agg(F.count(F.lit(1)).alias("points")))


def report_cells(df: DataFrame, tolerances=C.TOLERANCES) -> DataFrame:
    """Counts and sums by (season_year, actual, predicted): all that the report's metrics need."""
    e = _err(df)
    log_p = -F.ln(_clipped_p())
    sides = (("h", "_eh", "home_goals"), ("a", "_ea", "away_goals"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum(log_p).alias("log_p"), F.count(log_p).alias("log_n")]
    for k, err, goals in sides:
        sums += [F.count(err).alias(f"n_{k}"), F.sum(F.abs(err)).alias(f"abs_{k}"), F.sum(F.col(err) ** 2).alias(f"sq_{k}"),
                 F.sum(goals).alias(f"y_{k}"), F.sum(F.col(goals) ** 2).alias(f"yy_{k}")]
        sums += [F.count_if(F.abs(err) <= t).alias(f"in{i}_{k}") for i, t in enumerate(tolerances)]
    return e.groupBy("season_year", F.col("result").alias("actual"), F.col("pred_result").alias("predicted")).agg(*sums)


def eval_report(df: DataFrame, cross_validation: DataFrame | None = None, tolerances=C.TOLERANCES) -> DataFrame:
    """Every metric as one long table (section, metric, value).

    The matches are read once, into counts and sums by season, actual and predicted class; all
    metrics come from those few stored rows. ``cross_validation`` (target, metric, mean, std)
    adds the chosen models' fold scores.
    """
    cells = materialize(report_cells(df, tolerances), "report-cells")  # at most 16 rows a season
    names = [c for c in cells.columns if c not in ("season_year", "actual", "predicted")]
    total = cells.agg(*[F.sum(c).alias(c) for c in names], F.count_distinct("actual").alias("classes"))
    each = lambda df, section, values: df.select(F.lit(section).alias("section"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric") if isinstance(name, str) else name.alias("metric"), v.cast("double").alias("value")) for name, v in values])).alias("kv")).select("section", "kv.*")
    c = F.col
    mean = lambda x, k: F.try_divide(c(f"{x}_{k}"), c(f"n_{k}"))
    spread = lambda k: c(f"yy_{k}") - c(f"y_{k}") * c(f"y_{k}") / c("n")
    r2 = lambda k: F.when(spread(k) > 1e-9, 1 - c(f"sq_{k}") / spread(k))
    both = lambda x: (mean(x, "h") + mean(x, "a")) / 2
    goal = each(total, "goal_prediction", [
        ("mae_home", mean("abs", "h")), ("mae_away", mean("abs", "a")), ("mae_overall", both("abs")),
        ("rmse_home", F.sqrt(mean("sq", "h"))), ("rmse_away", F.sqrt(mean("sq", "a"))), ("r2_home", r2("h")), ("r2_away", r2("a")),
        *[(f"accuracy_within_{float(t)}", both(f"in{i}")) for i, t in enumerate(tolerances)]])
    cls = _per_class(cells.groupBy("actual", "predicted").agg(F.sum("n").alias("n")))
    per = each(cls, "result_prediction", [(F.concat(F.lower("class_name"), F.lit(f"_{m}")), c(m)) for m in ("precision", "recall", "f1")])
    summary = each(cls.limit(1), "result_prediction", [(m, c(m)) for m in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])
    loss = each(total.where(c("classes") == len(CLASSES)), "result_prediction", [("log_loss", F.try_divide("log_p", "log_n"))])
    right = F.sum(F.when(c("actual") == c("predicted"), c("n")).otherwise(0)) / F.sum(F.when(c("actual").isNotNull() & c("predicted").isNotNull(), c("n")))
    season = cells.groupBy("season_year").agg(*[F.sum(x).alias(x) for x in ("abs_h", "abs_a", "n_h", "n_a")], right.alias("accuracy"))
    label = c("season_year").cast("string")
    out = goal.union(per).union(summary).union(loss).union(each(season, "season_performance", [(label, both("abs"))]))
    out = out.union(each(season, "season_accuracy", [(label, c("accuracy"))])).union(each(total, "dataset", [("dataset_size", F.coalesce("n", F.lit(0)))]))
    if cross_validation is None:
        return out
    return out.union(each(cross_validation, "cross_validation", [(F.concat_ws("_", "target", "metric", F.lit(m)), c(m)) for m in ("mean", "std")]))
