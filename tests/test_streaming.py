from pyspark.sql import functions as F

from conftest import rows
from stumpline.plans import features
from stumpline.streaming import live


def test_stream_equals_batch(spark, tables, tmp_path):
    d, m = tables
    d.repartition(3).write.parquet(str(tmp_path / "balls"))
    states = live.live_innings_state(live.read_ball_stream(spark, str(tmp_path / "balls")))
    live.write_states(states, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = live.over_by_over(live.latest_states(spark, str(tmp_path / "out"))).where("inning = 1")
    want = features.build_over_sequences(d, m)
    columns = ["match_id", "over", "runs_in_over", "wickets_in_over", "boundaries_in_over", "balls_in_over",
               "cum_runs", "cum_wickets", "current_rr", "batting_team"]
    assert rows(got, *columns) == rows(want, *columns)


def test_restart_picks_up_where_it_stopped(spark, make_balls, tmp_path):
    balls, out, cp = (str(tmp_path / n) for n in ("balls", "out", "cp"))

    def run():
        states = live.live_innings_state(live.read_ball_stream(spark, balls))
        live.write_states(states, out, cp, available_now=True).awaitTermination()

    make_balls({"batsman_runs": 1}, {"over": 2, "batsman_runs": 2}).write.parquet(balls)
    run()
    # a late ball of over 1 corrects the overs after it; overs past the twentieth count like others
    make_balls({"ball": 6, "batsman_runs": 4}, {"over": 21, "batsman_runs": 1}, {"over": 30}).write.mode("append").parquet(balls)
    run()
    want = [(1, 5), (2, 7), (21, 8), (30, 8)]
    assert rows(live.over_by_over(live.latest_states(spark, out)), "over", "cum_runs") == want
    live.compact_states(spark, out)
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 1
    make_balls({"over": 2, "ball": 5, "batsman_runs": 1}).write.mode("append").parquet(balls)
    run()
    assert rows(live.over_by_over(live.latest_states(spark, out)), "over", "cum_runs") == [(1, 5), (2, 8), (21, 9), (30, 9)]


def test_chase_columns(spark, make_balls):
    d = make_balls({"inning": 2, "batting_team": "B", "batsman_runs": 6}, {"batsman_runs": 2})
    targets = spark.createDataFrame([(1, 30)], "match_id bigint, target bigint")
    got = live.over_by_over(live.live_innings_state(d), targets)
    assert rows(got, "inning", "runs_required", "required_rr") == [(1, None, None), (2, 24, 1.26)]


def test_old_matches_leave_the_state(spark, make_balls, tmp_path):
    balls = make_balls({"batsman_runs": 1}).withColumn("start", F.to_timestamp(F.lit("2020-01-01 10:00:00")))
    balls.write.parquet(str(tmp_path / "b"))
    stream = live.read_ball_stream(spark, str(tmp_path / "b"))
    states = live.live_innings_state(stream, match_start="start")
    live.write_states(states, str(tmp_path / "o"), str(tmp_path / "c"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
