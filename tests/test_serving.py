import pytest
from pyspark.sql import functions as F

from conftest import rows
from stumpline.operators import form
from stumpline.plans import features, serving

REQUEST = "request_id int, team1 string, team2 string, venue string, toss_winner string, toss_decision string, season int"


def test_match_request_rules(spark):
    df = spark.createDataFrame(
        [(1, "A", "B", "v", "team1", "bat", 2010), (2, "A", "B", "v", "A", "bowl", 2031), (3, "A", "B", "v", None, "bat", 2008)],
        REQUEST,
    )
    assert rows(serving.invalid_requests(df, serving.match_request_rules())) == [
        (2, "season"), (2, "toss_decision"), (2, "toss_winner"), (3, "toss_winner"),
    ]


def test_score_and_over_request_rules(spark):
    scores = spark.createDataFrame(
        [(1, 2010, 80, 3, 5), (2, 2010, 151, 11, -1)],
        "request_id int, season int, runs_10 int, wickets_10 int, boundaries_10 int",
    )
    assert rows(serving.invalid_requests(scores, serving.score_request_rules())) == [
        (2, "boundaries_10"), (2, "runs_10"), (2, "wickets_10"),
    ]
    overs = spark.createDataFrame(
        [(1, 2010, [(6, 0, 1)]), (2, 2010, [(37, 0, 0)] * 21), (3, 2010, [])],
        "request_id int, season int, overs array<struct<runs_in_over int, wickets_in_over int, boundaries_in_over int>>",
    )
    assert rows(serving.invalid_requests(overs, serving.over_request_rules())) == [
        (2, "overs_size"), (2, "runs_in_over"), (3, "overs_size"),
    ]


PLAYERS = ("request_id int, players array<struct<player_name string, runs_scored int, balls_faced int, "
           "wickets_taken int, runs_given int, balls_bowled int, player_won int>>")


def test_award_requests(spark):
    df = spark.createDataFrame(
        [(1, [("x", 30, 20, 0, 12, 9, 1), ("y", 0, 0, 2, 0, 0, 0)]), (2, [("z", 5, 0, 0, 0, 0, 2)]), (3, [])], PLAYERS
    )
    assert rows(serving.invalid_requests(df, serving.award_request_rules())) == [
        (2, "player_won"), (2, "runs_without_balls"), (3, "players_size"),
    ]
    got = serving.award_request_features(df.where("request_id = 1"))
    assert rows(got, "player_name", "strike_rate", "economy") == [("x", 150.0, 8.0), ("y", 0.0, 0.0)]
    ranked = serving.rank_players(got.withColumn("potm_probability", F.lit(10.0)))
    assert rows(ranked, "rank", "player_name") == [(1, "x"), (2, "y")]


def test_prematch_features_priors_and_history(spark, make_matches):
    m = make_matches(
        {}, {"winner": "B"}, {"winner": None}, {"season": 2011, "winner": "A"}, {"season": 2011, "team2": "C", "winner": "C"}
    )
    req = spark.createDataFrame(
        [(1, "A", "B", "Ground, X", "team2", "field", 2011), (2, "C", "A", "Ground, X", "team1", "bat", 2012),
         (3, "C", "B", "Ground, X", "team1", "bat", 2011)],
        REQUEST,
    )
    # undecided matches count as played; a team without earlier seasons gets one half
    got = serving.prematch_features(req, m)
    assert rows(got, "request_id", "toss_winner_is_team1", "bat_first", "win_rate_team1", "win_rate_team2") == [
        (1, 0, 0, 0.3333, 0.3333), (2, 1, 1, 1.0, 0.4), (3, 1, 1, 0.5, 0.3333),
    ]
    assert "rolling_bat_avg_diff" not in got.columns
    team_form = spark.createDataFrame(
        [(1, "A", 1.0, 1.0, 1.0, 1.0), (9, "A", 30.0, 130.0, 7.0, 18.0)],
        "match_id bigint, team string, rolling_bat_avg double, rolling_bat_sr double, rolling_bowl_econ double, rolling_bowl_sr double",
    )
    v3 = serving.prematch_features(req, m, team_form)
    assert rows(v3.where("request_id = 1"), "team1_rolling_bat_avg", "team2_rolling_bat_avg", "rolling_bat_avg_diff") == [
        (30.0, 25.0, 5.0)
    ]


def test_unknown_venue_fails_or_codes(spark, make_matches):
    m = make_matches({})
    req = spark.createDataFrame([(1, "A", "B", "Nowhere", "team1", "bat", 2011)], REQUEST)
    with pytest.raises(Exception, match="unrecognised venue: Nowhere"):
        serving.prematch_features(req, m).collect()
    assert serving.prematch_features(req, m, unknown="minus_one").first().venue_enc == -1


def test_score_request_features(spark, make_balls, make_matches):
    d = make_balls({"batsman_runs": 6})
    req = spark.createDataFrame(
        [(1, "A", "Ground, X", 2010, 85, 2, 9)],
        "request_id int, batting_team string, venue string, season int, runs_10 int, wickets_10 int, boundaries_10 int",
    )
    got = serving.score_request_features(req, d, make_matches({})).first()
    assert (got.current_rr, got.projected_score, got.scoring_pressure) == (8.5, 170.0, 7.9)


def test_over_request_states(spark):
    req = spark.createDataFrame(
        [(1, "A", "v", 2010, [(6, 0, 1), (9, 1, 1)])],
        "request_id int, batting_team string, venue string, season int, "
        "overs array<struct<runs_in_over int, wickets_in_over int, boundaries_in_over int>>",
    )
    got = serving.over_request_states(req)
    assert rows(got, "over", "cum_runs", "cum_wickets", "current_rr", "balls_in_over", "overs_seen") == [
        (1, 6, 0, 6.0, 6, 2), (2, 15, 1, 7.5, 6, 2),
    ]


def test_margin(spark):
    df = spark.createDataFrame([(10.04,)], "p double")
    assert tuple(serving.with_margin(df, "p", 13.0).first())[1:] == (10.0, -3.0, 23.0)
    assert serving.with_margin(df, "p", 13.0, floor=0).first().confidence_interval_low == 0.0


def test_match_listings(spark, tables):
    d, m = tables
    win = features.build_win_probability_features(d, m)
    usable = serving.usable_matches(win)
    assert usable.count() + serving.unusable_matches(m, win).count() == m.count()
    asked = spark.createDataFrame([(0,), (-5,)], "match_id bigint")
    assert rows(serving.unknown_matches(asked, win)) == [(-5,)]


def test_latest_form_is_the_highest_id(spark, tables):
    d, m = tables
    f = form.compute_team_rolling_form(d, m)
    latest = form.latest_team_form(f)
    want = {r.team: r.match_id for r in f.collect() if True}
    for r in f.collect():
        want[r.team] = max(want[r.team], r.match_id)
    assert {r.team: r.match_id for r in latest.collect()} == want
