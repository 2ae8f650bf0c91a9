"""Registered queries of the subpackage: (spark, sf_dir) -> DataFrame.

Each runs one operator over its whole table with the production parameters and
derives the digest columns from the operator's own results.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_table
from . import (decontam, fim, line_dedup, ngram_join, oracles, ppm, quality, secret_scan, sharding, sp_codec, token_counts, url_filter,
               vector_codes, warc)
from .util import documents

PIECE_MODEL = "piece_bpe_32k.model"


def model_path(name: str = PIECE_MODEL) -> str:
    """Place of a public tokenizer's file; RATIONFLOW_TOKENIZERS overrides the folder."""
    folder = os.environ.get("RATIONFLOW_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir), n=4, num=85, den=100)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in two loads through one ledger; the second finds the copies
    of what the first has scanned there."""
    docs = documents(spark, sf_dir)
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return secret_scan.scan_loads([docs.where(~second), docs.where(second)], new_table(spark, "ledger"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_score(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).drop("txt", "host")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.benchmark_hits(documents(spark, sf_dir), items).drop("txt")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return url_filter.url_filter(pages).drop("rule_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), model_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), 8)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sp_codec.encode_decode(documents(spark, sf_dir).select("doc_id", "text"), model_path())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select(
        "page_id", "url", "html", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("place"))
    return warc.archive(pages, "2024-01-01T00:00:00Z", locator="place").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(fim.restore().cast("binary"), 256).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ngram_join, op2_secret_scans, op3_lm_scoring, op4_quality_rules, op5_decontamination, op6_url_filters,
        op7_token_counts, op8_sharding, op9_sentencepiece, op10_line_dedup, op11_warc, op12_fill_in_middle, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    """The others have brute-force versions in tests/llm."""
    return {
        "op1_ngram_join": oracles.ngram_join(4, 85, 100),
        "op2_secret_scans": oracles.secret_scan(),
        "op4_quality_rules": oracles.quality(20, 0.002, 10, 0.2),
        "op8_sharding": oracles.sharding(8),
        "op11_warc": oracles.warc(0),
        "op12_fill_in_middle": oracles.fill_in_middle("1", 90, 20),
        "op13_vector_codes": oracles.vector_codes(8, 16, 6, 4096, 64),
    }
