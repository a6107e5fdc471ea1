import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

BALL = (
    "match_id bigint, inning int, over int, ball int, batting_team string, bowling_team string, batsman string, "
    "non_striker string, bowler string, is_super_over int, wide_runs int, bye_runs int, legbye_runs int, "
    "noball_runs int, penalty_runs int, batsman_runs int, extra_runs int, total_runs int, player_dismissed string, "
    "dismissal_kind string"
)
MATCH = (
    "id bigint, season int, city string, date string, team1 string, team2 string, toss_winner string, "
    "toss_decision string, winner string, win_by_runs int, win_by_wickets int, player_of_match string, venue string"
)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    """Cleaned (deliveries, matches) of the smallest scale."""
    from stumpline.sources import fixtures

    sf = "/root/testdata/sf0.001"
    return fixtures.deliveries(spark, sf), fixtures.matches(spark, sf)


@pytest.fixture(scope="session")
def make_balls(spark):
    """Cleaned ball table from partial rows; unnamed fields get plain values."""
    from stumpline.sources.clean import clean_deliveries

    names = [f.split()[0] for f in BALL.split(", ")]

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            base = dict(
                match_id=1, inning=1, over=1, ball=i + 1, batting_team="A", bowling_team="B", batsman="a1",
                non_striker="a2", bowler="b1", is_super_over=0, wide_runs=0, bye_runs=0, legbye_runs=0,
                noball_runs=0, penalty_runs=0, batsman_runs=0, player_dismissed=None, dismissal_kind=None,
            )
            base |= row
            extras = sum(base[c] or 0 for c in ("wide_runs", "bye_runs", "legbye_runs", "noball_runs", "penalty_runs"))
            base.setdefault("extra_runs", extras)
            base.setdefault("total_runs", base["batsman_runs"] + extras)
            full.append(tuple(base[n] for n in names))
        return clean_deliveries(spark.createDataFrame(full, BALL))

    return build


@pytest.fixture(scope="session")
def make_matches(spark):
    from stumpline.sources.clean import clean_matches

    names = [f.split()[0] for f in MATCH.split(", ")]

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            base = dict(
                id=i + 1, season=2010, city="X", date=f"2010-04-{i + 1:02d}", team1="A", team2="B", toss_winner="A",
                toss_decision="bat", winner="A", win_by_runs=1, win_by_wickets=0, player_of_match="a1",
                venue="Ground, X",
            )
            base |= row
            full.append(tuple(base[n] for n in names))
        return clean_matches(spark.createDataFrame(full, MATCH))

    return build


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
