"""Ordered computations that stay balanced when one key owns a large share of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. That is the cheapest
plan while every key is small, so each helper first asks the data (one pass over the key
columns, combined map-side). Where some key is larger than ``hot_rows``, Spark's range
partitioning by (key, order) cuts the rows into parts of equal weight and the cut table is
staged, which fixes the parts. Each (key, part) is then handled on its own, and what a part
needs from the earlier ones (running totals, or the last n rows) is carried over from a table
with one row per (key, part): as many as there are keys, plus the parts. Both ways give the
same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stumpline.sources.staging import staged

HOT_ROWS = 1_000_000  # rows of one key that a single window task may hold
RANGES = 256  # parts a table is cut into, or the shuffle partitions where those are more
NO_DATE = 2**63 - 1  # sorts after every date


def has_hot_key(df: DataFrame, key: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether some key has more than ``hot_rows`` rows; with no key the table is one group."""
    if not key:
        return df.count() > hot_rows
    return not df.groupBy(*key).count().where(F.col("count") > hot_rows).isEmpty()


def _key_text(key: Sequence[str]) -> Column:
    """The key as one text, different for different keys, never null: null keys form a group too."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in key]
    return F.to_json(F.array(*parts)) if len(parts) > 1 else parts[0]


def _in_ranges(
    df: DataFrame, key: Sequence[str], order: Sequence[str], ranges: int | None
) -> tuple[DataFrame, list[str]]:
    """Staged rows with the number of their part, and the columns to group by. Windows, totals and
    the join that brings the totals back all use exactly these columns: one shuffle of the rows."""
    group = ["_key"] if key else []
    rows = df.withColumn("_key", _key_text(key)) if key else df
    if ranges is None:
        ranges = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id())
    return staged(cut), group


def _join_ranges(rows: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    """Attach the table with one row per (key, part); without a key it has one row per part."""
    return rows.join(carried if group else F.broadcast(carried), [*group, "_range"])


def prior_totals(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    hot_rows: int = HOT_ROWS,
    ranges: int | None = None,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """Totals over the rows of the same key that come strictly earlier; 0 for the first row.

    ``order`` must be total within a key. An empty ``key`` runs over the whole table.
    ``ranges`` sets the number of parts by hand.
    ``sizing``: a cheaper table with at least as many rows per key, to look for large keys in.
    """
    if not has_hot_key(df if sizing is None else sizing, key, hot_rows):
        earlier = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()})

    rows, group = _in_ranges(df, key, order, ranges)
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    across = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*group, "_range")
        .agg(*[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()])
        .withColumns({f"_c_{n}": F.coalesce(F.sum(f"_c_{n}").over(across), F.lit(0)) for n in sums})
    )
    joined = _join_ranges(local, carried, group)
    return joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums}).select(*df.columns, *sums)


def trailing_mean(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    means: dict[str, str],
    n: int,
    hot_rows: int = HOT_ROWS,
    ranges: int | None = None,
    sizing: DataFrame | None = None,
) -> DataFrame:
    """Mean of each column over the ``n`` rows of the key before this one, null where there are none.

    ``means`` maps output name to input column; ``sizing`` is as for ``prior_totals``.
    """
    if not has_hot_key(df if sizing is None else sizing, key, hot_rows):
        frame = Window.partitionBy(*key).orderBy(*order).rowsBetween(-n, -1)
        return df.withColumns({out: F.avg(c).over(frame) for out, c in means.items()})

    values = F.struct(*[F.col(c).cast("double").alias(out) for out, c in means.items()])
    rows, group = _in_ranges(df, key, order, ranges)
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    local = rows.withColumns(
        {
            "_near": F.collect_list(values).over(inside.rowsBetween(-n, -1)),
            "_tail": F.collect_list(values).over(inside.rowsBetween(-(n - 1), 0)),
        }
    )
    # every part present holds at least one row, so n earlier parts hold the n rows needed
    across = Window.partitionBy(*group).orderBy("_range").rowsBetween(-n, -1)
    carried = (
        local.groupBy(*group, "_range")
        .agg(F.max_by("_tail", F.struct(*order)).alias("_tail"))
        .select(*group, "_range", F.flatten(F.collect_list("_tail").over(across)).alias("_carry"))
    )
    joined = _join_ranges(local.drop("_tail"), carried, group)
    joined = joined.withColumn("_seen", F.concat("_carry", "_near"))
    joined = joined.withColumn("_seen", F.slice("_seen", F.greatest(F.size("_seen") - (n - 1), F.lit(1)), n))

    def mean(out: str) -> Column:
        """Null values count neither in the sum nor in the number, as in ``avg``."""
        known = F.filter(F.transform("_seen", lambda row: row[out]), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v), F.size(known))

    return joined.withColumns({out: mean(out) for out in means}).select(*df.columns, *means)


def ranked(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    out: str = "rank",
    hot_rows: int = HOT_ROWS,
    ranges: int | None = None,
) -> DataFrame:
    """1-based position within the key, or within the whole table for an empty key."""
    placed = prior_totals(df, key, order, {out: F.lit(1)}, hot_rows, ranges)
    return placed.withColumn(out, (F.col(out) + 1).cast("bigint"))


def date_key(date: str = "date") -> Column:
    """Microseconds of a wall-clock timestamp as a whole number, missing dates last.

    Taken from the interval since 1970, so the session time zone plays no part.
    """
    since = F.col(date) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")

    def part(field: str, micros: int) -> Column:
        return (F.date_part(F.lit(field), since) * F.lit(micros)).cast("bigint")

    micros = part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000) + part("SECOND", 1_000_000)
    return F.coalesce(micros, F.lit(NO_DATE))
