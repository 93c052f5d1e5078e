"""A corpus pipeline of four stages over ``documents``.

Quality rules, near-duplicate removal, personal data, packing. Each stage takes
what the one before kept, reread from Parquet.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, pii, quality, simhash
from tessera.llm.common import documents, dropped, shared_folder

#: No SQL expresses fitted rules, signatures, bootstrapping or packing.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rule nor the learned rules reject."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked, and n_chars to match (a null text stays null)."""
    found = pii.extract(docs, keep=docs.columns)
    row, changed = F.col("row"), F.size("_spans") > 0
    masked = found.withColumn("_text", F.when(row["text"].isNotNull(), pii.masked(F.col("_text"), F.col("_spans"))))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return masked.select(*[new.get(c, row.getField(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and read again.

    A stage's table is deleted once the next one is written, so unmasked texts don't
    stay; the last stage's result reads the masked documents, which the caller keeps or deletes.
    """
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/tessera/stage{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if i:
                dropped(before)
    return docs
