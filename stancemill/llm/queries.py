"""The operators' queries: each over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stancemill.llm import collocations, decontam, embeddings, html, licences, lines, neardup, packing, quality, search, sharding, tokencount, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_round_trip(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and how many lines it had and lost."""
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document."""
    return tokencount.document_tokens(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and kept of every document."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, key and kept of every document."""
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the longest overlap of every document with a benchmark item."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h1", "h2")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
