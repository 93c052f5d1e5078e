"""The numbered operators as queries over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import divergence, fingerprints, licenses, packing, phrases, pieces, pii, quality, secrets, sharding, simhash, token_files, tokens
from tessera.llm.common import documents

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's directory is its source: one that is a license file stands for the others of its source that have none (a null source is no directory)."""
    path = F.concat_ws("/", F.col("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("text")))
    return licenses.scan(documents(spark, sf_dir).withColumn("path", path))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_token_counts, op3_licenses, op4_simhash, op5_sentencepiece, op6_packing, op7_quality, op8_fingerprints, op9_secrets, op10_sharding,
        op11_collocations, op12_token_files, op13_divergence,
    )
}

#: The other operators are not plain SQL: xxHash, checksums, tokenizers and
#: fitted models have no counterpart in the oracle's engine. Tests hold them
#: against brute-force versions.
ORACLE_SQL: dict[str, str] = {"op11_collocations": phrases.oracle_sql(), "op13_divergence": divergence.oracle_sql()}
