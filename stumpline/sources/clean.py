"""Cleaning of the raw tables: validation, team codes, derived flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.functions.exprs import same
from stumpline.schema import (
    DELIVERY_REQUIRED,
    DELIVERY_TEAM_COLUMNS,
    EXTRAS,
    MATCH_REQUIRED,
    MATCH_TEAM_COLUMNS,
    TEAM_CODES,
)


def validate_columns(df: DataFrame, required: Iterable[str], name: str) -> None:
    """Raise ValueError naming the missing columns. Looks at the schema only; no job runs."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"table {name} lacks {', '.join(missing)}; it has {', '.join(sorted(df.columns))}")


def abbreviate_teams(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Full team names to short codes; a name outside the map passes through."""
    present = [c for c in columns if c in df.columns]
    return df.replace(TEAM_CODES, subset=present) if present else df


def clean_matches(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    """``date_format`` is only needed for dates that are not ISO; unreadable dates become null."""
    validate_columns(raw, MATCH_REQUIRED, "matches")
    df = abbreviate_teams(raw.drop("umpire3"), MATCH_TEAM_COLUMNS)
    if "date" in df.columns:
        if date_format and dict(df.dtypes)["date"] == "string":
            # parse as UTC wall-clock so no session zone leaks in
            parsed = F.try_to_timestamp(F.col("date"), F.lit(date_format))
            df = df.withColumn("date", F.to_timestamp_ntz(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss")))
        else:
            df = df.withColumn("date", F.expr("try_cast(date AS timestamp_ntz)"))
    if "city" in df.columns:
        df = df.withColumn("city", F.coalesce("city", F.trim(F.element_at(F.split("venue", ","), -1))))
    return df.withColumn("toss_match_winner", same("toss_winner", "winner"))


def add_delivery_flags(df: DataFrame) -> DataFrame:
    """Back-fill the derived flags where a stored table lacks them."""
    if "is_legal_delivery" not in df.columns and {"wide_runs", "noball_runs"} <= set(df.columns):
        df = df.withColumn("is_legal_delivery", (F.col("wide_runs") == 0) & (F.col("noball_runs") == 0))
    if "is_wicket" not in df.columns:
        df = df.withColumn("is_wicket", F.col("player_dismissed").isNotNull())
    return df


def clean_deliveries(raw: DataFrame) -> DataFrame:
    validate_columns(raw, DELIVERY_REQUIRED, "deliveries")
    extras = [c for c in EXTRAS if c in raw.columns]
    df = raw.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in extras})
    # a missing flag is truthy, as in a float column read from CSV
    df = df.withColumn("is_super_over", F.coalesce(F.col("is_super_over").cast("boolean"), F.lit(True)))
    df = abbreviate_teams(df, DELIVERY_TEAM_COLUMNS)
    if {"wide_runs", "noball_runs"} <= set(df.columns):
        df = df.withColumn("is_legal_delivery", (F.col("wide_runs") == 0) & (F.col("noball_runs") == 0))
    dismissed = F.col("player_dismissed")
    return df.withColumn("is_wicket", dismissed.isNotNull() & (dismissed.cast("string") != "0"))
