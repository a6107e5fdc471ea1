"""The two raw tables projected from the order tables of a scale directory.

Each table is derived once per session and directory and written as Parquet under the shared
checkpoint folder, so that later queries are ordinary pruned Parquet scans.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from stumpline.sources.clean import clean_deliveries, clean_matches
from stumpline.sources.io import load_parquet, save_processed
from stumpline.sources.staging import work_dir

BALLS_SQL = Path(__file__).with_name("fixture_balls.sql").read_text().rstrip()
MATCHES_SQL = Path(__file__).with_name("fixture_matches.sql").read_text().rstrip()
FIXTURE_SQL = f"{BALLS_SQL},\n{MATCHES_SQL}"  # the same text runs in Spark and in other SQL engines
_TEAMS_SQL = re.search(r"fx_team AS \(.*?\(ti, tname\)\)", BALLS_SQL, re.S).group(0)
_TABLE = re.compile(r"\b(FROM|JOIN) (lineitem|orders|customer|nation|region|deliveries_csv)\b")

_built: dict[tuple[str, str, str], str] = {}


def table_dir(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each directory: its last name, and a hash of the whole path for those of the same name."""
    path = sf_dir.rstrip("/")
    name = f"{path.rsplit('/', 1)[-1]}-{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    return f"{work_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}"


def materialised(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write ``build()`` on first use in this session, then read the written table."""
    known = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if known not in _built:
        _built[known] = save_processed(build(), name, table_dir(spark, sf_dir))
    return load_parquet(spark, name, table_dir(spark, sf_dir))


def _sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    for table in set(t for _, t in _TABLE.findall(text)) - set(frames):
        frames[table] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return spark.sql(_TABLE.sub(r"\1 {\2}", text), **frames)


def raw_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = BALLS_SQL.replace("deliveries_csv AS (", "balls AS (") + " SELECT * FROM balls"
    return materialised(spark, sf_dir, "deliveries_raw", lambda: _sql(spark, sf_dir, text))


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"WITH {_TEAMS_SQL},\n{MATCHES_SQL} SELECT * FROM matches_csv"

    def build() -> DataFrame:
        return _sql(spark, sf_dir, text, deliveries_csv=raw_deliveries(spark, sf_dir))

    return materialised(spark, sf_dir, "matches_raw", build)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned ball table."""
    return materialised(spark, sf_dir, "deliveries", lambda: clean_deliveries(raw_deliveries(spark, sf_dir)))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned match table."""
    return materialised(spark, sf_dir, "matches", lambda: clean_matches(raw_matches(spark, sf_dir)))
