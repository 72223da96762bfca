"""Model pipeline smoke: trains, scores every fixture, probabilities sum to one."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL


def test_score_future(spark, tables):
    s = entry.queries()["score_future"](spark, SMALL)
    n_future = tables.matches().where(F.col("result").isNull()).count()
    assert s.count() == n_future
    # query outputs are rounded to 6 places, so allow three rounding steps
    bad = s.where(F.abs(F.col("`prob_-1`") + F.col("prob_0") + F.col("prob_1") - 1) > 2e-6).count()
    assert bad == 0
    assert s.where(F.col("pred_home_goals") < 0).count() == 0


def test_past_rows_are_split(tables):
    from kickoff.operators import clean as CL
    past, _ = CL.split_past_future(tables.matches())
    n = past.count()
    split = CL.time_split(tables.matches())
    assert split.count() == n and 0.78 * n <= split.where("is_train").count() <= 0.8 * n


def test_winner_is_used(spark, tables):
    from kickoff.plans.catalog_model import _chosen, _models
    goals, result = _chosen(tables)
    (home, away, outcome), f, cols = _models(tables)
    assert home.getOrDefault("maxDepth") == away.getOrDefault("maxDepth") == goals[1]["maxDepth"]
    assert outcome.getOrDefault("maxDepth") == result[1]["maxDepth"]
    saved = entry.queries()["save_load_model"](spark, SMALL).collect()
    assert len(saved) == f.where(F.col("result").isNotNull() & ~F.col("is_train")).count()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
