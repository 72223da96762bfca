"""What grows with the tables: no sort of all values, few exchanges, few stored rows, few micro-batches."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from kickoff.operators import features as FE
from kickoff.operators import ranking as RK

MATCH = "league bigint, match_date date, home_team string, away_team string, home_goals double, away_goals double, result int, season_year int, venue string"


def matches(spark):
    r = random.Random(1)
    days = [dt.date(2020, 8, 1) + dt.timedelta(days=3 * i) for i in range(40)]
    rows = {(league, r.choice(days), *r.sample("ABCDEF", 2)) for league in (1, 2) for _ in range(150)}
    played = [(k, float(r.randrange(4)), float(r.randrange(4))) for k in sorted(rows)]
    return spark.createDataFrame([(*k, h, a, (h > a) - (h < a), 2020, "V") for k, h, a in played], MATCH)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_quantiles_without_a_sort_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(RK, "_sorted_quantiles", lambda *a: 1 / 0)
    r = np.random.default_rng(3)
    data = {"even": r.random(40000), "tied": r.integers(0, 7, 40000).astype(float), "step": np.where(r.random(40000) < 0.5, 1.0, 2.0 + r.random(40000))}
    df = spark.createDataFrame(list(zip(range(40000), *(x.tolist() for x in data.values()))), ["i", *data])
    df = df.withColumn("even", F.when(F.col("i") % 5 == 0, F.lit(float("nan"))).when(F.col("i") % 5 == 1, None).otherwise(F.col("even"))).withColumn("none", F.lit(None).cast("double"))
    data["even"] = data["even"][np.arange(40000) % 5 > 1]
    got = RK.exact_quantiles(df, [*data, "none"], [0.0, 0.25, 0.5, 0.999, 1.0])
    assert got.pop("none") == [None] * 5
    for c, values in got.items():
        assert np.allclose(values, np.quantile(data[c], [0.0, 0.25, 0.5, 0.999, 1.0]), rtol=0, atol=1e-15), c


def test_quantiles_of_few_values(spark):
    for n in range(1, 9):
        values = [float(x * x) for x in range(n)]
        got = RK.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], [0.25, 0.5, 0.75])
        assert np.allclose(got["v"], np.quantile(values, [0.25, 0.5, 0.75])), n


def test_few_exchanges(spark):
    m = matches(spark)
    assert exchanges(FE.form_features(m)) == 2
    # a season's states, ranks and both sides stay where the season was dealt to
    plan = FE.league_position(m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("Exchange hashpartitioning(league") == 0 and exchanges(FE.league_position(m)) == 1
    assert exchanges(FE.feature_table(m)) <= 8  # three of them number the label codes


def test_positions_are_those_of_the_table(spark):
    m = matches(spark)
    table = {(r.league, r.as_of, r.team): r.position for r in FE.asof_season_table(m).collect()}
    got = FE.league_position(m).collect()
    assert len(got) == m.count()
    for r in got:
        for team, place in ((r.home_team, r.home_league_position), (r.away_team, r.away_league_position)):
            assert place == table.get((r.league, r.match_date, team), FE.C.POSITION_DEFAULT)


def test_matches_store_no_raw_rows(spark, tmp_path):
    from kickoff import fixtures
    spark.range(40).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(200).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 7).alias("l_linenumber"), F.col("id").alias("l_partkey"), (F.col("id") % 40).alias("l_suppkey"),
        F.lit(dt.datetime(1999, 1, 1)).alias("l_shipdate"), F.lit(5.0).alias("l_quantity"), F.lit(1234.5).alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = fixtures.Tables(spark, str(tmp_path))
    n = t.matches().count()
    assert [k[-1] for k in fixtures._FEATURE_CACHE if k[1] == str(tmp_path)] == ["matches"]
    assert n == spark.sql(fixtures.MATCHES_SQL, raw_matches=t.raw_matches()).count() > 0


def test_page_files_do_not_grow_with_the_leagues(spark, tmp_path):
    from kickoff.plans.catalog_stream import PAGE_FILES, arrive
    pages = spark.range(700).select(F.col("id").alias("league"), F.lit("2020-2021").alias("season"), F.lit("<p>").alias("html"))
    arrive(pages, str(tmp_path / "in"), PAGE_FILES)
    assert len(list((tmp_path / "in").glob("part-*"))) <= PAGE_FILES and spark.read.json(str(tmp_path / "in")).count() == 700


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strength_scores_where_positions_are(spark, tables):
    from kickoff.operators import evaluate as EV
    from kickoff.operators.features import league_position
    from kickoff.operators.history import MATCH_KEY
    from kickoff.plans.catalog_eval import q_perf_strength
    got = q_perf_strength(tables)
    assert "Join" not in plan_of(got)
    joined = EV.perf_by_strength(tables.predictions().join(league_position(tables.matches()), MATCH_KEY))
    of = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert of(got) == of(joined)


def test_lookup_meets_a_pair_once(spark):
    from kickoff.operators.requests import PRED_FIELDS, lookup_prediction
    preds = spark.createDataFrame([("s", d, h, "B", "1", "0", "1", i) for i, (d, h) in enumerate(
        [("2020-01-02", "A"), ("", " a "), ("2020-01-01", "A"), ("2020-01-01", "C"), ("2020-01-01", "C")])], ", ".join(f"{c} string" for c in PRED_FIELDS) + ", ordinal int")
    asked = [(1, "A", "2020-01-02", "2020-01-02"), (2, "A", "2020-01-01", ""), (3, "a", None, "2020-01-02"), (4, "C", "2020-01-01", "2020-01-01"),
             (5, "C", "2020-01-09", None), (6, "c", " ", "2020-01-01"), (7, None, None, None), (8, "A", "2020-01-09", "")]
    requests = spark.createDataFrame([(i, h, "b", d) for i, h, d, _ in asked], "id int, req_home string, req_away string, req_date string")
    got = lookup_prediction(requests, preds)
    assert {r["id"]: r["pred_date"] for r in got.collect()} == {i: found for i, _, _, found in asked}
    assert plan_of(got).count("Join ") == 2  # three, and the requests read twice, before


def test_elo_arrivals_are_written_by_all_tasks(spark, tables, monkeypatch):
    import os
    from kickoff.plans import catalog_stream as CS
    paths = []
    made = CS.scratch_path
    monkeypatch.setattr(CS, "scratch_path", lambda s, name: (paths.append(made(s, name)), paths[-1])[1])
    n = CS.q_stream_elo(tables).count()
    files = sum(f.endswith(".parquet") for f in os.listdir(paths[0]))
    seasons = tables.matches().select("season_year").distinct().count()
    assert n == tables.matches().count() and files > 4 * seasons  # 4 a season before


def test_a_cells_text_is_found_once(spark):
    from kickoff.sources import html as HT
    named = matches(spark).withColumns({c: F.concat(F.lit("FC "), c) for c in ("home_team", "away_team")})
    made = HT.fixtures_pages(named)
    assert "partial_collect_list" not in made._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]  # pages are built where their rows were dealt to
    pages = spark.createDataFrame(made.select("league", "season_year", "html").collect())
    plan = plan_of(HT.extract_fixtures(pages))
    assert plan.count("(?s)<[^>]*>") <= 6  # five of them for a page; 42 before
    got = {(r.league, r.date, r.home_team, r.away_team, r.home_goals, r.away_goals) for r in HT.extract_fixtures(pages).collect()}
    assert got == {(r.league, str(r.match_date), r.home_team, r.away_team, int(r.home_goals), int(r.away_goals)) for r in named.collect()}


def test_date_texts_as_by_every_format(spark):
    from kickoff.functions import constants as C
    from kickoff.functions import scalars as S
    texts = ["2020-01-31", " 31/1/2020 ", "5 Ene 2021", "mar 4, 2020", "4 diciembre 2020", "May 4, 2020", "june 4, 2020", "31-01-2020", "2020/01/31", "1/2 2020", "a-b/c d", "x", "", " ", None, "-5/3/1", "2020-02-30"]
    x = F.lower(S.strip_ws("t"))
    for es, en in C.SPANISH_MONTHS:
        x = F.replace(x, F.lit(es), F.lit(en))
    plain = F.coalesce(F.date_format(F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in C.DATE_TEXT_FORMATS]), "yyyy-MM-dd"), x)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", S.parse_date_text("t").alias("got"), plain.alias("want")).collect():
        assert r.got == (r.want if r.t else "")


def test_momentum_looks_back_only_as_far_as_it_counts(spark):
    import re
    plan = plan_of(FE.momentum_features(matches(spark)).select("home_momentum"))
    assert len(set(re.findall(r"lag\(g#\d+L?, (-?\d+)", plan))) == FE.C.MOMENTUM_SPAN  # 15 before
    assert "POWER" not in plan.upper()  # a power and all newer entries for each of the 8 before


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    from kickoff.session import HUGE_METHOD, configure
    name, limit = HUGE_METHOD
    assert spark.conf.get(name) == limit
    spark.conf.set(name, "20000")
    configure(spark)
    assert spark.conf.get(name) == "20000"  # somebody's own choice stays
    spark.conf.set(name, "65535")
    configure(spark)
    assert spark.conf.get(name) == limit
