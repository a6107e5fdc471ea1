"""Model metrics as aggregations over a scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stumpline.functions.exprs import ratio, rnd, total
from stumpline.functions.ordered import HOT_ROWS, prior_totals

PROBABILITY_FLOOR = 2.220446049250313e-16  # double precision epsilon


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def binary_metrics(scored: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: accuracy, log loss, and precision, recall, F1 of the positive class (0 when undefined)."""
    p = F.least(F.greatest(F.col(score), F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    hit, real = F.col(score) > threshold, F.col(label) == 1
    loss = -F.when(real, F.log(p)).otherwise(F.log(1 - p))
    counts = scored.agg(
        F.count(F.lit(1)).alias("n"),
        total(hit & real).alias("tp"),
        total(hit & ~real).alias("fp"),
        total(~hit & real).alias("fn"),
        F.avg(loss).alias("loss"),
    )
    precision, recall = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    f1 = ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))
    return counts.select(
        "n",
        ratio(F.col("n") - F.col("fp") - F.col("fn"), "n", 4).alias("accuracy"),
        rnd("loss", 4).alias("log_loss"),
        rnd(_zero(precision), 4).alias("precision_pos"),
        rnd(_zero(recall), 4).alias("recall_pos"),
        rnd(_zero(f1), 4).alias("f1_pos"),
    )


def score_table(scored: DataFrame, score: str, label: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per distinct score: positives and negatives there, and at all higher scores."""
    real = F.col(label) == 1
    levels = (
        scored.where(F.col(score).isNotNull())
        .groupBy((-F.col(score)).alias("_down"))
        .agg(total(real).alias("pos"), total(~real).alias("neg"))
    )
    return prior_totals(
        levels, [], ["_down"], {"pos_above": F.col("pos"), "neg_above": F.col("neg")}, hot_rows
    )


def roc_auc(scored: DataFrame, score: str, label: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    t = score_table(scored, score, label, hot_rows)
    area = F.sum((F.col("pos_above") * 2 + F.col("pos")) * F.col("neg"))
    counts = t.agg(area.alias("twice"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return counts.select(
        rnd(F.try_divide(F.col("twice").cast("double"), F.col("p").cast("double") * F.col("n") * 2), 4).alias(
            "roc_auc"
        )
    )


def average_precision(scored: DataFrame, score: str, label: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    t = score_table(scored, score, label, hot_rows)
    hits = F.col("pos_above") + F.col("pos")
    seen = hits + F.col("neg_above") + F.col("neg")
    step = F.col("pos") * hits.cast("double") / seen
    counts = t.agg(F.sum(step).alias("s"), F.sum("pos").alias("p"))
    return counts.select(rnd(F.try_divide(F.col("s"), F.col("p").cast("double")), 4).alias("avg_precision"))


def regression_metrics(scored: DataFrame, prediction: str, target: str) -> DataFrame:
    """Mean absolute error (2 places) and R squared (4 places); R squared is 0 for a constant target."""
    y, e = F.col(target).cast("double"), F.col(target) - F.col(prediction)
    one = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("res"),
        (F.var_pop(y) * F.count(y)).alias("tot"),
    )
    r2 = F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0)
    return one.select("n", rnd("mae", 2).alias("mae"), rnd(r2, 4).alias("r2"))


def class_balance(df: DataFrame, target: str, places: int = 4) -> DataFrame:
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", ratio("n", df.agg(F.count(target)).scalar(), places))


def class_weight(df: DataFrame, target: str) -> DataFrame:
    """Weight of a positive row that balances the classes: negatives / positives."""
    counts = df.agg(total(F.col(target) == 0).alias("negative"), total(F.col(target) == 1).alias("positive"))
    return counts.withColumn("positive_weight", ratio("negative", "positive"))


def target_correlations(df: DataFrame, features: list[str], target: str, places: int = 6) -> DataFrame:
    """Pearson correlation of each feature with the target, strongest first."""
    one = df.agg(*[F.corr(f, target).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), rnd(f, places).alias("correlation")) for f in features])
    long = one.select(F.explode(pairs).alias("p")).select("p.*")
    return long.orderBy(F.desc_nulls_last(F.abs("correlation")), "feature")


def describe_column(df: DataFrame, column: str, places: int = 2) -> DataFrame:
    """count, mean, std, min, exact quartiles, max."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n"))
    quartiles = counts.agg(cuts.alias("q")).scalar()
    one = df.agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"),
    )
    return one.select(
        "count", rnd("mean", places).alias("mean"), rnd("std", places).alias("std"), "min",
        *[rnd(quartiles[i], places).alias(n) for i, n in enumerate(("q25", "q50", "q75"))],
        "max",
    )


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between the smallest and the largest value; empty bins are left out."""
    r = df.agg(F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))).scalar()
    width = F.try_divide(r["hi"] - r["lo"], F.lit(float(bins)))
    place = F.coalesce(F.floor(F.try_divide(F.col(column) - r["lo"], width)), F.lit(0))
    binned = df.where(F.col(column).isNotNull()).groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
    return binned.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("smallest"), F.max(column).alias("largest"))


def trend_line(df: DataFrame, x: str, y: str, places: int = 6) -> DataFrame:
    """Least-squares line y = slope * x + intercept."""
    return df.agg(
        rnd(F.regr_slope(y, x), places).alias("slope"), rnd(F.regr_intercept(y, x), places).alias("intercept")
    )


def quartiles_by_class(df: DataFrame, target: str, columns: list[str], places: int = 4) -> DataFrame:
    """min, exact quartiles and max of each column per class, in long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(target, F.explode(pairs).alias("p")).select(target, "p.*")
    counts = long.groupBy(target, "feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n"))
    boxes = counts.groupBy(target, "feature").agg(F.min("value").alias("low"), cuts.alias("_q"), F.max("value").alias("high"))
    return boxes.select(
        target, "feature", "low", *[rnd(F.col("_q")[i], places).alias(n) for i, n in enumerate(("q25", "q50", "q75"))],
        "high",
    )


def mean_by(df: DataFrame, keys: list[str], value: str, out: str, places: int) -> DataFrame:
    return df.groupBy(*keys).agg(rnd(F.avg(value), places).alias(out))
