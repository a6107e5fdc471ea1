"""Column expressions shared by every operator. All JVM-side, none of them a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stumpline.schema import PHASES, UNCREDITED_DISMISSALS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, places: int) -> Column:
    """Half-even rounding on the binary-scaled value (what NumPy does)."""
    scale = float(10**places)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def ratio(num: Column | str, den: Column | str, places: int | None = None, scale: float | None = None) -> Column:
    """num / den, null when den is zero; optionally times ``scale``, optionally rounded."""
    out = F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
    if scale is not None:
        out = out * F.lit(float(scale))
    return out if places is None else rnd(out, places)


def truth(cond: Column) -> Column:
    """A comparison with a null in it counts as false."""
    return F.coalesce(cond, F.lit(False))


def same(a: Column | str, b: Column | str) -> Column:
    return truth(_col(a) == _col(b))


def flag(cond: Column) -> Column:
    return truth(cond).cast("int")


def total(cond: Column) -> Column:
    return F.count_if(cond)


def boundary(runs: Column | str = "batsman_runs") -> Column:
    return _col(runs).isin(4, 6)


def phase_of(over: Column | str = "over") -> Column:
    out = None
    for label, first, last in PHASES:
        hit = _col(over).between(first, last)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def ball_position() -> Column:
    """Order of a ball inside its match as one integer."""
    return F.col("inning").cast("bigint") * 10000 + F.col("over") * 100 + F.col("ball")


def totals_with_side(
    df: DataFrame, keys: list, side: str, totals: dict[str, Column], near: str = "match_id"
) -> DataFrame:
    """Additive ``totals`` per key, with the first non-null ``side`` (a team) in playing order.

    A text-valued aggregate would make Spark sort the balls, so the side first joins the grouping
    keys (a hash aggregation, combined map-side) and the earliest side is picked from what is left:
    one row per key in clean data. That second step runs partitioned by ``near``, where the
    windows and joins that follow need the rows anyway.
    """
    grouped = df.groupBy(*keys, side).agg(
        *[c.alias(n) for n, c in totals.items()], F.min(ball_position()).alias("_first")
    )
    names = [c for c in grouped.columns if c not in (side, "_first", *totals)]
    earliest = F.min_by(side, F.when(F.col(side).isNotNull(), F.col("_first")))
    return (
        grouped.repartition(near)
        .groupBy(*names)
        .agg(*[F.sum(n).alias(n) for n in totals], earliest.alias(side))
    )


def credited_wicket(df: DataFrame) -> Column:
    """Dismissal credited to the bowler; an unknown kind of dismissal counts."""
    out = F.col("player_dismissed").isNotNull()
    if "dismissal_kind" in df.columns:
        out = out & ~truth(F.col("dismissal_kind").isin(*UNCREDITED_DISMISSALS))
    return out


def charged_runs(df: DataFrame) -> Column:
    """Runs charged to the bowler: byes and leg-byes stripped where the columns exist."""
    out = F.col("total_runs")
    for extra in ("bye_runs", "legbye_runs"):
        if extra in df.columns:
            out = out - F.col(extra)
    return out


def regulation(df: DataFrame) -> DataFrame:
    """Balls outside super overs."""
    return df.where(~F.col("is_super_over"))


def first_innings(df: DataFrame) -> DataFrame:
    return regulation(df).where(F.col("inning") == 1)
