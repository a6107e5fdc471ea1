import pytest
from pyspark.sql import functions as F

from conftest import rows
from stumpline.operators import form, players, teams, venues


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.first().asDict()


@pytest.fixture(scope="module")
def spell(make_balls):
    return make_balls(
        {"batsman_runs": 4},
        {"wide_runs": 1},
        {"batsman_runs": 6, "over": 7},
        {"player_dismissed": "a2", "dismissal_kind": "run out"},
        {"batsman": "a2", "bye_runs": 2, "over": 21},
        {"batsman": "a3", "noball_runs": 1, "bowler": "b2"},
        {"batsman": "a1", "batsman_runs": 6, "is_super_over": 1},
        {"batsman": "a2", "player_dismissed": "a2"},
    )


def test_batting_career(spell):
    got = one(players.batting_career_stats(spell), batsman="a1")
    # the run-out of the partner is charged to the striker; the super over and the wide do not count as balls
    assert got["runs"] == 10 and got["balls_faced"] == 3 and got["dismissals"] == 1
    assert got["dot_balls"] == 1 and got["strike_rate"] == 333.33 and got["boundary_pct"] == 100.0
    empty = one(players.batting_career_stats(spell), batsman="a3")
    assert empty["balls_faced"] == 0 and empty["strike_rate"] is None and empty["average"] is None


def test_bowling_career_is_legal_balls_only(spell):
    stats = players.bowling_career_stats(spell)
    assert rows(stats, "bowler") == [("b1",)]  # b2 bowled only a no-ball
    got = one(stats, bowler="b1")
    assert got["balls_bowled"] == 5 and got["runs_conceded"] == 12 and got["wickets"] == 2
    assert got["overs_bowled"] == 0.83 and got["economy"] == 14.46  # 12 / 0.83


def test_phase_grid_is_complete(spell):
    grid = players.batting_phase_stats(spell)
    assert grid.count() == 9
    assert rows(grid.where("batsman = 'a1'"), "phase", "runs", "balls", "sixes") == [
        ("Death", 0, 0, None), ("Middle", 6, 1, 1), ("Powerplay", 4, 2, 0),
    ]
    assert players.batting_phase_stats(spell, fill_sixes=0).where("sixes IS NULL").count() == 0
    assert players.bowling_phase_economy(spell).count() == 3


def test_partnerships_need_the_partner(spell):
    with pytest.raises(ValueError, match="non_striker"):
        players.partnership_stats(spell.drop("non_striker"))
    swapped = players.partnership_stats(
        spell.withColumn("batsman", F.when(F.col("ball") == 1, "a2").otherwise("a1")).withColumn(
            "non_striker", F.when(F.col("ball") == 1, "a1").otherwise("a2")
        )
    )
    assert rows(swapped, "player1", "player2", "total_runs", "partnerships") == [("a1", "a2", 10, 1)]


def test_player_pages(spell, make_matches):
    m = make_matches({"season": 2010})
    bat = one(players.player_batting(spell, m), player="a2")
    assert bat["dismissals"] == 2 and bat["average"] == 0.0
    never_out = one(players.player_batting(spell, m), player="a1")
    assert never_out["dismissals"] == 0 and never_out["average"] == 10.0
    assert players.player_batting(spell, m, seasons=(2011, 2012)).count() == 0
    bowl = one(players.player_bowling(spell, m), player="b1")
    # byes stripped, wide charged, run-out not credited, unknown kind credited, under one over: economy 0
    assert bowl["runs_conceded"] == 11 and bowl["wickets"] == 1 and bowl["economy"] == 0.0
    none = one(players.player_bowling(spell, m), player="b2")
    assert none["average"] == float("inf") and none["dot_pct"] == 0.0
    assert one(players.player_bowling(spell, m, never=None), player="b2")["average"] is None


def test_bowling_without_optional_columns(spell):
    bare = spell.drop("bye_runs", "legbye_runs", "dismissal_kind")
    got = one(form.player_match_bowling(bare), player="b1")
    assert got["bowl_econ"] == pytest.approx(12 / (5 / 6)) and got["bowl_sr"] == 2.5


def test_per_match_form(spell):
    bat = one(form.player_match_batting(spell), player="a3")
    assert bat["bat_avg"] == 0.0 and bat["bat_sr"] == 0.0 and bat["team"] == "A"
    assert one(form.player_match_bowling(spell), player="b1")["bowl_sr"] == 5.0


def test_all_players_and_leaderboards(tables):
    d, _ = tables
    everyone = players.all_players(d)
    assert everyone.count() == everyone.distinct().count() == 88
    top = players.batting_leaderboard(d).collect()
    assert len(top) == 15 and [r.runs for r in top] == sorted((r.runs for r in top), reverse=True)


def test_venue_par_exact_median(make_balls, make_matches):
    balls = [{"match_id": i, "batsman_runs": r, "ball": 1} for i, r in ((1, 1), (2, 2), (3, 6), (4, 4))]
    m = make_matches({}, {}, {}, {"venue": None})
    got = venues.venue_par_scores(make_balls(*balls), m).collect()
    assert [tuple(r) for r in got] == [("Ground, X", 3.0, 2.0, 3)]


def test_head_to_head(make_matches):
    m = make_matches({}, {"winner": "B"}, {"winner": "A"}, {"winner": None}, {"team2": "C", "winner": "C"})
    assert rows(teams.head_to_head(m)) == [("A", "B", 2), ("B", "A", 1), ("C", "A", 1)]
    wide = teams.head_to_head_matrix(m)
    assert set(wide.columns) == {"team", "A", "B"} and one(wide, team="A")["A"] == 0
    assert teams.head_to_head_matrix(m, ["A", "B", "C"]).columns == ["team", "A", "B", "C"]


def test_super_over_winner(make_balls, make_matches):
    d = make_balls({"is_super_over": 1, "inning": 3, "batsman_runs": 4}, {"is_super_over": 1, "inning": 4, "batting_team": "B"})
    scores = teams.super_over_scores(d, make_matches({}))
    assert rows(scores, "batting_team", "runs", "won") == [("A", 4, True), ("B", 0, False)]
    assert teams.super_over_matches(d).first()[0] == 1


def test_qualified_medians_shape(tables):
    got = players.qualified_medians(tables[0], min_balls=10)
    assert rows(got, "role", "metric") == [
        ("batting", "average"), ("batting", "strike_rate"), ("bowling", "economy"), ("bowling", "strike_rate"),
    ]
