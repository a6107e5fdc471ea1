import datetime

import pytest

from conftest import rows
from stumpline.operators import quality
from stumpline.sources import clean, io, staging

MATCH_HEAD = "id,season,city,date,team1,team2,toss_winner,toss_decision,winner,win_by_runs,win_by_wickets,player_of_match,venue,umpire3,crowd"


def write(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_matches_csv(spark, tmp_path):
    path = write(
        tmp_path, "matches.csv", MATCH_HEAD,
        "1,2008,,2008-04-18,Mumbai Indians,Deccan Chargers,Mumbai Indians,bat,Mumbai Indians,10,0,p,\"Eden Park, Side, Kolkata \",,9",
        "2,2008,Pune,not a date,Pune Warriors,Someone Else,Pune Warriors,field,,0,0,,Ground,u,9",
    )
    df = io.load_matches(spark, path)
    assert "umpire3" not in df.columns and "crowd" in df.columns
    assert rows(df, "id", "city", "date", "team1", "team2", "winner", "toss_match_winner") == [
        (1, "Kolkata", datetime.datetime(2008, 4, 18), "MI", "DC_old", "MI", True),
        (2, "Pune", None, "PW", "Someone Else", None, False),
    ]


def test_matches_csv_other_date_format(spark, tmp_path):
    path = write(tmp_path, "m.csv", MATCH_HEAD, "1,2008,x,18/04/2008,A,B,A,bat,A,1,0,p,v,,")
    df = io.load_matches(spark, path, date_format="dd/MM/yyyy")
    assert df.first().date == datetime.datetime(2008, 4, 18)


def test_missing_columns_are_named(spark, tmp_path):
    path = write(tmp_path, "m.csv", "id,season", "1,2008")
    with pytest.raises(ValueError, match="toss_winner"):
        io.load_matches(spark, path)


def test_deliveries_csv_fills_extras_and_flags(spark, tmp_path):
    path = write(
        tmp_path, "d.csv",
        "match_id,inning,batting_team,bowling_team,over,ball,batsman,bowler,is_super_over,wide_runs,noball_runs,batsman_runs,extra_runs,total_runs,player_dismissed",
        "1,1,Mumbai Indians,Delhi Capitals,1,1,a,b,0,,,4,,4,",
        "1,1,Mumbai Indians,Delhi Capitals,1,2,a,b,1,1,0,0,1,1,",
        "1,1,Mumbai Indians,Delhi Capitals,1,3,a,b,,0,1,0,1,1,a",
    )
    df = io.load_deliveries(spark, path)
    assert rows(df, "ball", "batting_team", "bowling_team", "wide_runs", "extra_runs", "is_super_over",
                "is_legal_delivery", "is_wicket") == [
        (1, "MI", "DC", 0, 0, False, True, False),
        (2, "MI", "DC", 1, 1, True, False, False),
        (3, "MI", "DC", 0, 1, True, False, True),
    ]
    assert "bye_runs" not in df.columns


def test_load_both_and_roundtrip(spark, tmp_path, tables):
    d, m = tables
    m.limit(3).toPandas().to_csv(tmp_path / "m.csv", index=False)
    d.limit(5).withColumn("is_super_over", d.is_super_over.cast("int")).toPandas().to_csv(tmp_path / "d.csv", index=False)
    matches, deliveries = io.load_both(spark, str(tmp_path / "m.csv"), str(tmp_path / "d.csv"))
    assert matches.count() == 3 and deliveries.count() == 5
    io.save_processed(m, "matches", str(tmp_path / "out"), partition_by="season")
    back = io.load_parquet(spark, "matches", str(tmp_path / "out"))
    assert rows(back.select(*m.columns)) == rows(m)


def test_missing_table_is_a_clear_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nothing.parquet"):
        io.load_parquet(spark, "nothing", str(tmp_path))


def test_backfill_keeps_present_flags(tables):
    d, _ = tables
    assert clean.add_delivery_flags(d).columns == d.columns
    again = clean.add_delivery_flags(d.drop("is_wicket", "is_legal_delivery"))
    assert rows(again, "match_id", "inning", "over", "ball", "is_wicket", "is_legal_delivery") == rows(
        d, "match_id", "inning", "over", "ball", "is_wicket", "is_legal_delivery"
    )


@pytest.mark.parametrize("first, status", [(0, "zero_indexed"), (1, "ok"), (2, "unexpected_minimum")])
def test_over_index(make_balls, first, status):
    assert quality.over_index_check(make_balls({"over": first}, {"over": first + 3})).first().status == status


def test_quality_reports(make_matches):
    m = make_matches({}, {"winner": None, "season": 1900}, {"team1": "Mumbai Indians"})
    assert rows(quality.null_report(m, ["winner", "team1"]), "column", "nulls") == [("team1", 0), ("winner", 1)]
    assert quality.range_report(m, {"season": (2000, None)}).first().violations == 1
    assert quality.value_report(m, ["team1"], ["Mumbai Indians"]).first().found == 0


def test_staged_table_is_the_same(spark, tables):
    _, m = tables
    copy = staging.staged(m)
    assert copy.schema == m.schema and rows(copy) == rows(m)


def test_filters_and_columns_reach_the_scan(tables, capsys):
    from stumpline.operators.players import player_batting

    d, m = tables
    player_batting(d, m, ["Mumbai Indians P1"], (1993, 1997)).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(batsman,Mumbai Indians P1)" in plan
    assert "GreaterThanOrEqual(season,1993)" in plan
    assert "bowling_team" not in plan


def test_drop_staged_removes_only_this_sessions_tables(spark, tables):
    _, m = tables
    copy = staging.staged(m)
    staging.drop_staged(spark)
    with pytest.raises(Exception, match="not exist|NOT_EXIST|NOT_FOUND"):
        copy.collect()
    assert m.count() > 0


def test_directories_of_the_same_name_have_their_own_tables(spark, tmp_path):
    from pathlib import Path

    from stumpline.sources import fixtures

    for parent, scale in (("a", "sf0.001"), ("b", "sf0.01")):
        (tmp_path / parent).mkdir()
        (tmp_path / parent / "sf").symlink_to(Path("/root/testdata") / scale)
    first, second = str(tmp_path / "a" / "sf"), str(tmp_path / "b" / "sf")
    counts = [fixtures.matches(spark, d).count() for d in (first, second, first)]
    assert counts[0] == counts[2] != counts[1]


def test_intermediate_tables_go_to_a_shared_folder(spark):
    assert staging.work_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
