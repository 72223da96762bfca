"""Properties: Elo conservation, no look-ahead, order independence, plan shape."""

from pyspark.sql import functions as F

from kickoff.operators import features as FE
from kickoff.operators.history import MATCH_KEY


def test_elo_sum_is_constant_per_league(tables):
    # a match moves both ratings by the same amount: after any match the two sides' next
    # ratings sum to what they were, so a league's last known ratings sum to 1500 a team
    m = tables.matches().where("league = 0").orderBy("match_date", "home_team", "away_team").toPandas()
    book = FE.EloBook(32.0, 1500.0)
    for h, a, r in zip(m["home_team"], m["away_team"], m["result"]):
        book.play([h], [a], [r])
        assert abs(sum(book.ratings.values()) - 1500.0 * len(book.ratings)) < 1e-6
    assert len(set(round(v, 3) for v in book.ratings.values())) > 1


def test_team_names_keep_long_numbers(spark):
    from kickoff.fixtures import TEAM_ALIASES_SQL
    suppliers = spark.range(1, 10002).withColumnRenamed("id", "s_suppkey")
    named = spark.sql(TEAM_ALIASES_SQL, supplier=suppliers)
    assert named.select("canonical").distinct().count() == 10001


def test_requests_of_known_matches_are_answered(spark, tables):
    from kickoff.operators.requests import append_fixtures
    m = tables.matches()
    asked = m.select(*MATCH_KEY).limit(5).unionByName(m.select("league", F.date_add("match_date", 9000).alias("match_date"), "home_team", "away_team").limit(5))
    out = append_fixtures(m, asked.unionByName(asked))
    assert out.where("is_request").count() == asked.distinct().count() and out.count() == m.count() + 5


def test_matrix_has_few_exchanges(tables):
    plan = FE.feature_table(tables.matches())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 20


def test_scratch_goes_with_its_scope(spark, tmp_path):
    import os

    from kickoff.session import materialize, scratch_scope
    with scratch_scope():
        path = materialize(spark.range(3), "probe").inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))


def test_adding_later_matches_never_changes_earlier_features(tables):
    m = tables.matches()
    early = m.where(F.col("match_date") < F.lit("1998-01-01").cast("date"))
    a = FE.appearance_features(early).join(FE.head_to_head(early), MATCH_KEY)
    b = FE.appearance_features(m).join(FE.head_to_head(m), MATCH_KEY).join(early.select(*MATCH_KEY), MATCH_KEY,
                                                                           "left_semi")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_repartitioning_input_does_not_change_output(tables):
    m = tables.matches()
    a = FE.league_position(m)
    b = FE.league_position(m.repartition(7, "home_team"))
    assert a.exceptAll(b).count() == 0


def test_asof_features_have_no_nested_loop_or_cartesian_join(tables):
    m = tables.matches()
    for df in (FE.appearance_features(m), FE.head_to_head(m), FE.league_position(m), FE.venue_features(m)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_season_filter_prunes_partitions(spark, tables):
    from kickoff.session import scratch_path
    from kickoff.sources.standings import scan_standings_json, sink_standings, standings_snapshot
    path = scratch_path(spark, "standings-test")
    snap = standings_snapshot(tables.matches())
    sink_standings(snap, path)
    season = snap.agg(F.max("season")).first()[0]
    df = scan_standings_json(spark, path, season)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    assert df.count() == snap.where(F.col("season") == season).count()
