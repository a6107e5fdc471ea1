"""Train/test splits that depend on the data only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stumpline.functions.exprs import rnd
from stumpline.functions.ordered import HOT_ROWS, ranked
from stumpline.sources.staging import staged

TEST_SHARE = 0.2


def temporal_cut(df: DataFrame, id_column: str = "match_id", share: float = TEST_SHARE,
                 hot_rows: int = HOT_ROWS):
    """Largest id still in training: the last floor(share * n) distinct ids are the test set.

    With so few ids that the test set is empty, everything is training data. The result is one
    plain value, so using it costs no shuffle and the comparison can reach the scan.
    """
    ids = staged(df.select(id_column).where(F.col(id_column).isNotNull()).distinct())
    n = ids.count()
    placed = ranked(ids, [], [id_column], "_rank", hot_rows)
    at_cut = placed.where(F.col("_rank") == n - int(n * share)).first()
    return None if at_cut is None else at_cut[id_column]


def temporal_split(df: DataFrame, id_column: str = "match_id", share: float = TEST_SHARE,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``is_test``; a row without an id trains."""
    later = F.col(id_column) > F.lit(temporal_cut(df, id_column, share, hot_rows))
    return df.withColumn("is_test", F.coalesce(later, F.lit(False)))


def _shuffled_key(key: list[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))


def _placed(df: DataFrame, key: list[str], label: str | None, hot_rows: int) -> DataFrame:
    """Rank and size within the label, in the order of a hash of the row key."""
    rows = df.withColumn("_h", _shuffled_key(key))
    by = [] if label is None else [label]
    rows = ranked(rows, by, ["_h"], "_rank", hot_rows)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if label is None:
        return rows.withColumn("_n", sizes.scalar())
    return rows.join(F.broadcast(sizes), label)  # one row per class


def stratified_split(
    df: DataFrame, key: list[str], label: str | None, share: float = TEST_SHARE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds ``is_test``: within each class the first (1 - share) by hash of the key train."""
    placed = _placed(df, key, label, hot_rows)
    return placed.withColumn("is_test", F.col("_rank") > F.col("_n") * F.lit(1 - share)).drop("_h", "_rank", "_n")


def stratified_folds(
    df: DataFrame, key: list[str], label: str, folds: int = 5, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds ``fold`` 0..folds-1 of near-equal size within each class."""
    placed = _placed(df, key, label, hot_rows)
    # the first (n mod folds) folds take one row more, as ntile does
    size, big = F.floor(F.col("_n") / folds), F.col("_n") % folds
    at = F.col("_rank") - 1
    in_big = at < big * (size + 1)
    fold = F.when(in_big, F.floor(at / (size + 1))).otherwise(big + F.floor((at - big * (size + 1)) / F.greatest(size, F.lit(1))))
    return placed.withColumn("fold", fold.cast("int")).drop("_h", "_rank", "_n")


# ---- normalisation fitted on the training rows ----


def fit_normaliser(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation per feature, a near-zero deviation replaced by 1. One pass."""
    row = df.agg(
        *[F.avg(f).alias(f"{f}__mean") for f in features], *[F.stddev_samp(f).alias(f"{f}__std") for f in features]
    ).first()
    return {
        f: (row[f"{f}__mean"], 1.0 if row[f"{f}__std"] is not None and row[f"{f}__std"] < 1e-6 else row[f"{f}__std"])
        for f in features
    }


def normalise(df: DataFrame, stats: dict[str, tuple[float, float]], places: int | None = None) -> DataFrame:
    """z-scores by the fitted values."""

    def z(f: str) -> Column:
        mean, std = stats[f]
        out = (F.col(f) - F.lit(mean)) / F.lit(std)
        return out if places is None else rnd(out, places)

    return df.withColumns({f: z(f) for f in stats})


def scale_season(df: DataFrame, fitted_on: DataFrame | None = None, out: str = "season_norm") -> DataFrame:
    """Min-max scaled season; a single season scales to 0."""
    r = (df if fitted_on is None else fitted_on).agg(
        F.struct(F.min("season").alias("lo"), F.max("season").alias("hi"))
    ).scalar()
    return df.withColumn(out, (F.col("season") - r["lo"]) / F.greatest(r["hi"] - r["lo"], F.lit(1)))
