"""Data-quality reports: one pass over the table each, results small and independent of its size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stumpline.functions.exprs import total, truth


def over_index_check(deliveries: DataFrame) -> DataFrame:
    """Overs must be numbered from 1: smallest, largest, and a verdict."""
    low = F.col("over_min")
    verdict = F.when(low == 0, "zero_indexed").when(low != 1, "unexpected_minimum").otherwise("ok")
    return deliveries.agg(F.min("over").alias("over_min"), F.max("over").alias("over_max")).withColumn("status", verdict)


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _counts(df, {c: F.col(c).isNull() for c in columns}, "column", "nulls")


def range_report(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside their closed range, per column; an open end is None. Nulls are not violations."""

    def outside(c: str) -> Column:
        low, high = ranges[c]
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        return bad

    return _counts(df, {c: outside(c) for c in ranges}, "column", "violations")


def value_report(df: DataFrame, columns: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows per column that still hold one of ``values`` (names that should have been replaced)."""
    return _counts(df, {c: F.col(c).isin(*values) for c in columns}, "column", "found")


def _counts(df: DataFrame, checks: dict[str, Column], name: str, out: str) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[total(truth(c)).alias(k) for k, c in checks.items()])
    cells = [F.struct(F.lit(k).alias(name), F.col("_rows").alias("rows"), F.col(k).alias(out)) for k in checks]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def listing(matches: DataFrame) -> DataFrame:
    """The sides and grounds by name: (kind, name), for health pages."""
    named = [("team", "team1"), ("team", "team2"), ("venue", "venue")]
    names = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for kind, c in named])
    return matches.select(F.explode(names).alias("n")).select("n.*").where(F.col("name").isNotNull()).distinct().orderBy("kind", "name")


def dataset_profile(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Table sizes and distinct counts, one row.

    Distinct values are counted as (kind, value) groups, so no task sees all of one column.
    """

    def pairs(df: DataFrame, kinds: dict[str, Sequence[str]]) -> DataFrame:
        cells = [
            F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
            for kind, columns in kinds.items()
            for c in columns
        ]
        return df.select(F.explode(F.array(*cells)).alias("p")).select("p.*").where(F.col("value").isNotNull())

    rows = pairs(matches, {"teams": ["team1", "team2"], "venues": ["venue"], "seasons": ["season"]}).unionByName(
        pairs(deliveries, {"batsmen": ["batsman"], "bowlers": ["bowler"]})
    )
    distinct = rows.groupBy("kind", "value").agg(F.lit(1).alias("one"))
    kinds = ("teams", "venues", "seasons", "batsmen", "bowlers")
    one = distinct.agg(*[total(F.col("kind") == k).alias(k) for k in kinds])
    return one.select(
        matches.agg(F.count(F.lit(1))).scalar().alias("matches"),
        deliveries.agg(F.count(F.lit(1))).scalar().alias("deliveries"),
        *kinds,
    )


def invalid_rows(df: DataFrame, rules: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per broken rule: ``keep`` columns plus ``rule``. A rule that evaluates to null is broken."""
    broken = F.array(*[F.when(~truth(ok), F.lit(name)) for name, ok in rules.items()])
    rows = df.select(*keep, F.explode(F.array_compact(broken)).alias("rule"))
    return rows
