"""From raw documents to encoded training rows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``docs``, extra ones included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import mixing, piece_bpe, quality_rules, scratch, secret_scan, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, and outliers of their language and source, go.

    Null and empty texts have no words and go; null languages and sources are
    groups of their own; repeated rows are judged alike.  Whole texts are read.  An
    empty table gives an empty one, and extra columns, whatever their names, stay.
    """
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles are as similar as 0.8 to those of one with a smaller id go.

    Of rows that tie, fully repeated ones included, one stays; a null id counts as
    largest.  Null and empty texts are like each other.  Whole texts are
    compared.  An empty table gives an empty one, and extra columns stay.
    """
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds; all documents stay.

    A null text stays null, a row without secrets as it is; repeated rows are
    changed alike.  Whole texts are read.  An empty table gives an empty one, and
    extra columns stay.
    """
    return secret_scan.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources come to their target weights, and shuffled.

    A null source is a source; rows with equal ids (null ones, too) in a source
    are repeated alike.  An empty table gives an empty one, and extra columns stay.
    """
    return mixing.replicate(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids in place of its text, and the number of them.

    A null or empty text has no ids; null ids, languages and sources stay null;
    repeated rows give repeated rows.  Whole texts are encoded.  An empty table
    gives an empty one; extra columns don't stay.
    """
    encoded = piece_bpe.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.selectExpr("doc_id", "lang", "source", "cast(size(ids) as bigint) as n_tokens", "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("secret_scans", secrets_stage),
    ("source_mixing", mixing_stage),
    ("piece_encoding", encoding_stage),
]

#: SQL expresses neither the robust estimates nor the merges; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages make of the table ``documents``.

    A stage's scratch tables and its input (but for ``documents``) are removed
    once its result is written; what the last stage wrote stays for the caller.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch.new_path(spark, f"stage-{name}")
        with scratch.swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            scratch.remove(spark, before)
        before = path
    return docs
