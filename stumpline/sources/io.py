"""Readers and writers: raw CSV in, Parquet tables out and back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from stumpline.schema import DELIVERY_CSV, DELIVERY_REQUIRED, MATCH_CSV, MATCH_REQUIRED
from stumpline.sources.clean import clean_deliveries, clean_matches, validate_columns


def _read_csv(spark: SparkSession, path: str, known: dict[str, str], required, name: str) -> DataFrame:
    """Types come from the declared schema, never from inference over the data.

    Only the header line is read up front, so a file may order its columns freely,
    miss optional ones, or carry further ones (kept as strings).
    """
    header = spark.read.option("header", True).csv(path)
    validate_columns(header, required, name)
    ddl = ", ".join(f"`{c}` {known.get(c, 'STRING')}" for c in header.columns)
    return spark.read.schema(ddl).option("header", True).option("enforceSchema", False).csv(path)


def load_matches(spark: SparkSession, path: str, date_format: str | None = None) -> DataFrame:
    return clean_matches(_read_csv(spark, path, MATCH_CSV, MATCH_REQUIRED, "matches.csv"), date_format)


def load_deliveries(spark: SparkSession, path: str) -> DataFrame:
    return clean_deliveries(_read_csv(spark, path, DELIVERY_CSV, DELIVERY_REQUIRED, "deliveries.csv"))


def load_both(spark: SparkSession, matches_path: str, deliveries_path: str) -> tuple[DataFrame, DataFrame]:
    return load_matches(spark, matches_path), load_deliveries(spark, deliveries_path)


def save_processed(df: DataFrame, name: str, out_dir: str, partition_by: str | None = None) -> str:
    """Overwrite ``out_dir/name.parquet``; the directory is made by the writer."""
    path = f"{out_dir.rstrip('/')}/{name}.parquet"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def load_parquet(spark: SparkSession, name: str, in_dir: str) -> DataFrame:
    path = f"{in_dir.rstrip('/')}/{name}.parquet"
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"Processed table not found: {path}. Build the feature tables first.") from error
