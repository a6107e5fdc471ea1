"""Corpus cleaning: the stages that turn raw documents into packed training sequences.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables, and returns
documents with the same columns; the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stumpline.llm.cluster import staged
from stumpline.llm.exact_dedup import without_copies
from stumpline.llm.jaccard_join import one_of_each_class
from stumpline.llm.packing import packed_documents
from stumpline.llm.secrets import masked
from stumpline.llm.toxicity import trained, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return without_toxic(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that five-word shingles link at a similarity of 0.8 or more."""
    return one_of_each_class(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    return masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 4096 tokens: every token of every document once."""
    return packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Scores and sequences aren't SQL; tests/llm/test_pipeline.py holds the rows against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
