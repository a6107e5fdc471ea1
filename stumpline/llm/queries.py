"""The registered queries of this package: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stumpline.llm.centroid_clustering import clustered
from stumpline.llm.cluster import staged
from stumpline.llm.embedding_dedup import similar_vectors
from stumpline.llm.exact_dedup import exact_duplicates
from stumpline.llm.html_extract import extracted
from stumpline.llm.huffman import new_path, summarised_ids, write_ids
from stumpline.llm.jaccard_join import similar_documents
from stumpline.llm.packing import packed_documents
from stumpline.llm.secrets import digest, scanned
from stumpline.llm.sentencepiece_bpe import summarised
from stumpline.llm.substring_dedup import repeats_removed
from stumpline.llm.tokens import id_type, tokenised
from stumpline.llm.top_k_search import searched
from stumpline.llm.toxicity import scored, trained
from stumpline.llm.whitening import whitened
from stumpline.sources.staging import drop_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    tokens = staged(tokenised(table(spark, sf_dir, "documents")), "zstd")
    write_ids(tokens, path, id_type())
    drop_table(tokens)
    return summarised_ids(spark, path)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scanned(table(spark, sf_dir, "documents")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(table(spark, sf_dir, "embeddings"), by_row=True)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_dropout": op1_sentencepiece_dropout,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_token_files": op8_token_files,
    "op9_packing": op9_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_embedding_whitening": op13_embedding_whitening,
}
