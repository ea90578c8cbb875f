"""One query for each operator of this subpackage, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import gru_lm, html_blocks, license_scan, mixing, piece_bpe, quality_rules, rans_tokens, secret_scan, simhash, tiff_media


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' columns, with the number of the copy and its place in the random order."""
    return mixing.replicate(_table(spark, sf_dir, "documents"), extra=("copy_no", "place"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(_table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encoding_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_media.media_report(_table(spark, sf_dir, "documents"))


def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_tokens.tokens_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extraction_report(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_license_scans, op2_quality_rules, op3_source_mixing, op4_simhash_near_dedup, op5_gru_scores, op6_secret_scans, op7_piece_encoding, op8_tiff_media, op9_rans_tokens, op10_html_extraction)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": license_scan.oracle_sql(), "op3_source_mixing": mixing.ORACLE_SQL}
