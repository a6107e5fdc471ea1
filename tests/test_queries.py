"""Every registered query beside its SQL, on the smallest scale."""

from glob import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import _rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return connection


# these train 300 trees on each of five folds; check.py runs them beside their SQL
CROSS_VALIDATED = {"match_winner_model", "feature_importance", "prematch_scored", "model_summary"}


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - CROSS_VALIDATED))
def test_query_matches_sql(spark, db, name):
    df = contract.queries()[name](spark, SF)
    cur = db.execute(contract.oracle_sql()[name])
    assert _rows(df.columns, df.collect()) == _rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["score_requests", "over_scored", "potm_rank", "calibration_by_over"])
def test_model_query_has_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
