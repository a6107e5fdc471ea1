"""Ordinal label codes: alphabetical position among the distinct labels, -1 for a missing one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stumpline.functions.ordered import HOT_ROWS, ranked

SMALL_LABELS = 100_000  # a dictionary up to this size is ranked in one task and broadcast


def labels_are_few(df: DataFrame, columns, limit: int = SMALL_LABELS) -> bool:
    """One pass with a fixed-size sketch per column."""
    seen = df.agg(*[F.approx_count_distinct(c) for c in columns]).first()
    return all(n <= limit for n in seen)


def label_codes(df: DataFrame, column: str, few: bool | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Dictionary (label, code) of the labels in ``column``."""
    labels = df.select(F.col(column).alias("label")).where(F.col("label").isNotNull()).distinct()
    if few is None:
        few = labels_are_few(df, [column])
    if few:
        return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("code"))
    return ranked(labels, [], ["label"], "code", hot_rows).withColumn("code", (F.col("code") - 1).cast("int"))


def union_label_codes(df: DataFrame, *columns: str) -> DataFrame:
    """One dictionary over several columns."""
    pooled = df.select(F.explode(F.array(*columns)).alias("label"))
    return label_codes(pooled, "label", labels_are_few(df, columns))


def with_codes(df: DataFrame, codes: DataFrame, column: str, out: str, unknown: str = "minus_one",
               few: bool | None = None) -> DataFrame:
    """Look labels up in a fitted dictionary.

    unknown: "minus_one", "zero", "null", or "error" (the job fails naming the label).
    A small dictionary is broadcast; beyond that the join strategy is left to the optimizer.
    ``few`` says which it is where the caller has checked already.
    """
    if few is None:
        few = codes.limit(SMALL_LABELS + 1).count() <= SMALL_LABELS
    fitted = codes.select(F.col("label").alias("_label"), F.col("code").alias("_code"))
    joined = df.join(F.broadcast(fitted) if few else fitted, F.col(column) == F.col("_label"), "left")
    code = F.col("_code")
    if unknown == "error":
        complaint = F.raise_error(F.concat(F.lit(f"unrecognised {column}: "), F.coalesce(F.col(column), F.lit("null"))))
        code = F.when(code.isNotNull(), code).otherwise(complaint.cast("int"))
    elif unknown != "null":
        code = F.coalesce(code, F.lit({"minus_one": -1, "zero": 0}[unknown]))
    return joined.withColumn(out, code.cast("int")).drop("_label", "_code")


def unknown_labels(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Labels that a fitted dictionary does not know."""
    return (
        df.select(F.col(column).alias("label"))
        .where(F.col("label").isNotNull())
        .distinct()
        .join(codes, "label", "left_anti")
    )


def encode(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Fit on ``df`` and attach codes; ``columns`` maps label column to output column.

    ``df`` is read once more per column, and once for the size of the dictionaries.
    """
    few = labels_are_few(df, columns)
    fitted = {c: label_codes(df, c, few) for c in columns}
    for column, out in columns.items():
        df = with_codes(df, fitted[column], column, out, few=few)
    return df
