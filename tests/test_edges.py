"""Hand-made edge rows per operator (defaults, ties, nulls, boundaries)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kickoff.functions import scalars as S
from kickoff.operators import clean as CL
from kickoff.operators import evaluate as EV
from kickoff.operators import features as FE
from kickoff.operators import model as MD

M_SCHEMA = ("league bigint, match_date date, home_team string, away_team string, home_goals double, "
            "away_goals double, venue string, result int, season_year int")


def d(s):
    return dt.date.fromisoformat(s)


def matches(spark, rows):
    out = []
    for lg, date, h, a, hg, ag in rows:
        r = None if hg is None or ag is None else (1 if hg > ag else -1 if hg < ag else 0)
        day = d(date)
        season = day.year if day.month >= 8 else day.year - 1
        out.append((lg, day, h, a, hg, ag, f"{h} Ground", r, season))
    return spark.createDataFrame(out, M_SCHEMA)


def test_same_day_matches_do_not_see_each_other(spark):
    m = matches(spark, [(0, "2000-09-01", "A", "B", 2.0, 0.0), (0, "2000-09-01", "A", "C", 1.0, 0.0),
                        (0, "2000-09-08", "A", "D", 0.0, 0.0)])
    f = {r["away_team"]: r for r in FE.form_features(m).collect()}
    assert f["B"]["home_form_3"] == 0.0 and f["C"]["home_form_3"] == 0.0  # first day: no history
    assert f["D"]["home_form_3"] == pytest.approx(6 / 6)  # two wins, n = 2
    e = {r["away_team"]: r for r in FE.elo_ratings(m).collect()}
    assert e["C"]["home_elo"] > 1500  # Elo does update within a day


def test_unplayed_dilutes_form_stops_streak_skipped_by_momentum(spark):
    m = matches(spark, [(0, "2000-09-01", "A", "B", 1.0, 0.0), (0, "2000-09-02", "A", "C", None, None),
                        (0, "2000-09-03", "A", "D", 1.0, 0.0), (0, "2000-09-04", "A", "E", 0.0, 0.0)])
    f = {r["away_team"]: r for r in FE.form_features(m).collect()}
    assert f["E"]["home_form_3"] == pytest.approx(6 / 9)  # unplayed counts in n
    mo = {r["away_team"]: r for r in FE.momentum_features(m).collect()}
    assert mo["E"]["home_win_streak"] == 1  # newest first: win, then unplayed stops
    assert mo["E"]["home_momentum"] == pytest.approx((1.0 + 0.9 * 1.0) / (1 + 0.9))  # unplayed skipped
    assert mo["B"]["home_momentum"] == 0.5 and mo["B"]["home_win_streak"] == 0


def test_h2h_and_venue_defaults(spark):
    m = matches(spark, [(0, "2000-09-01", "A", "B", 1.0, 1.0), (0, "2000-09-05", "B", "A", 3.0, 0.0)])
    h = {r["home_team"]: r for r in FE.head_to_head(m).collect()}
    assert (h["A"]["h2h_home_wins"], h["A"]["h2h_matches_count"], h["A"]["h2h_total_goals_avg"]) == (0.33, 0, 3.0)
    # second meeting, perspective of B at home: the earlier 1-1 was a draw
    assert h["B"]["h2h_draws"] == 1.0 and h["B"]["h2h_home_goals_avg"] == 1.0
    v = {r["home_team"]: r for r in FE.venue_features(m).collect()}
    assert (v["A"]["home_venue_advantage"], v["A"]["away_venue_performance"]) == (0.5, 0.3)


def test_league_table_ties_by_team_name(spark):
    m = matches(spark, [(0, "2000-09-01", "B", "A", 1.0, 1.0), (0, "2000-09-02", "C", "D", None, None)])
    t = {r["team"]: r["position"] for r in FE.league_table(m).collect()}
    assert t == {"A": 1, "B": 2, "C": 3, "D": 4}  # equal points and gd -> name order; unplayed listed


def test_league_position_defaults(spark):
    m = matches(spark, [(0, "2000-09-01", "A", "B", 2.0, 0.0), (0, "2000-09-08", "C", "A", 0.0, 0.0)])
    p = {r["home_team"]: r for r in FE.league_position(m).collect()}
    assert (p["A"]["home_league_position"], p["A"]["home_points_per_game"]) == (10, 1.5)
    assert (p["C"]["home_league_position"], p["C"]["away_league_position"]) == (10, 1)  # C absent -> 10


@pytest.mark.parametrize("raw,expected", [("-1", None), ("0", 0.0), ("10", 10.0), ("11", None), ("x", None),
                                          (None, None)])
def test_clean_goals(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "g string")
    assert df.select(S.clean_goals("g")).first()[0] == expected


@pytest.mark.parametrize("month,season,cat", [(1, 1999, "mid_season"), (5, 1999, "late_season"), (6, 1999, None),
                                              (7, 1999, None), (8, 2000, "early_season"), (12, 2000, "mid_season")])
def test_season_and_month_category(spark, month, season, cat):
    df = spark.createDataFrame([(dt.date(2000, month, 15),)], "match_date date")
    r = df.select(S.season_of("match_date").alias("s"), S.month_category(F.month("match_date")).alias("c")).first()
    assert (r["s"], r["c"]) == (season, cat)


@pytest.mark.parametrize("text,goals", [("2–1", (2, 1)), ("2:1", (2, 1)), ("(4) 1-1 (3)", (4, 1)), ("", (None, None)),
                                        ("3", (None, None))])
def test_parse_score(spark, text, goals):
    r = spark.createDataFrame([(text,)], "s string").select(S.parse_score("s").alias("p")).first()["p"]
    assert (r["home_goals"], r["away_goals"]) == goals


def test_prediction_rounding_half_even_and_clamp(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.6,)], "x double")
    assert [r[0] for r in df.select(S.round_half_even_nonneg("x")).collect()] == [0, 2, 2, 0]


def test_alias_before_trim(spark):
    df = spark.createDataFrame([("Real Madrid CF", " FC Barcelona ")], "home_team string, away_team string")
    r = CL.trim_team_names(CL.canon_team_names(df)).first()
    assert (r["home_team"], r["away_team"]) == ("Real Madrid", "FC Barcelona")  # padded alias is not mapped


def test_classification_absent_classes_give_zero(spark):
    rows = [(1, 1, 0.5, 0.2, 0.3), (1, 1, 0.5, 0.2, 0.3), (0, 1, 0.5, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "result int, pred_result int, prob_home double, prob_draw double, prob_away double")
    m = {r["class_name"]: r for r in EV.classification_metrics(df).collect()}
    assert m["Draw"]["precision"] == 0.0 and m["Draw"]["recall"] == 0.0 and m["Draw"]["f1"] == 0.0
    assert EV.log_loss(df).count() == 0  # away class never actual -> undefined


def test_confidence_bins_top_bands(spark):
    rows = [(1, 1, p, (1 - p) / 2, (1 - p) / 2) for p in (0.85, 0.95, 1.0)]
    df = spark.createDataFrame(rows, "result int, pred_result int, prob_home double, prob_draw double, prob_away double")
    b = {r["bin"]: r["predictions"] for r in EV.confidence_bins(df).collect()}
    assert b == {"0.8-0.9": 1, "0.9-1.0": 1}  # exactly 1.0 is excluded


def test_robust_scale_constant_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (1.0, None)], "c double, n double")
    params = MD.robust_scale_fit(df, ["c"])
    assert params["c"] == (1.0, 1.0)
    med = MD.impute_median(df, ["c", "n"])
    assert med == {"c": 1.0, "n": None}


def _text(spark, html):
    from kickoff.sources.html import text_of
    return spark.createDataFrame([(html,)], "h string").select(text_of(F.col("h")).alias("t")).first().t


def test_entities_are_decoded_once(spark):
    assert _text(spark, "2&#8211;1") == "2–1" and _text(spark, "<b>2&#x2013;1</b>") == "2–1"
    assert _text(spark, "Alav&eacute;s &#233;") == "Alavés é"
    assert _text(spark, "a &amp;lt; b &nope; & &lt;") == "a &lt; b &nope; & <"


def test_attribute_names_are_whole(spark):
    from kickoff.sources.html import extract_fixtures
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in ("Date", "Time", "Home", "Score", "Away")) + "</tr>"
    row = "<tr><td>2020-01-05</td><td>20:00</td><td>Alav&eacute;s</td><td>2&#8211;1</td><td>Beta</td></tr>"
    page = f'<table data-id="sched"><tr><td>x</td></tr></table><table class=big id=sched_1>{head}{row}</table>'
    got = extract_fixtures(spark.createDataFrame([(1, 2019, page), (2, 2019, "<p>none</p>")], "league bigint, season_year int, html string")).collect()
    assert [(r.home_team, r.home_goals, r.away_goals) for r in got] == [("Alavés", 2, 1)]
