"""The training-data pipeline: five stages over documents, each over all that the one before kept.

Stages: quality rules (line-first cleaning takes failing lines out of the texts it keeps), quality
classifier, exact dedup, near-dedup by SimHash, packing. SQL cannot express the classifier, the
fingerprints' components or the packing, so ORACLE_SQL is None; tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from residua.llm import compression, exact_dedup, packing, quality_rules, simhash
from residua.llm.common import limit_batches, limit_reads, scratch_path

TOKENIZER = "byte_bpe_50k.json"


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail; n_chars follows the text."""
    limit_reads(spark)
    return quality_rules.clean_documents(docs, length_col="n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more; the model learns from the documents and labels of sf_dir."""
    limit_batches(spark)
    limit_reads(spark)
    model = compression.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: that with the smallest doc_id."""
    limit_reads(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    limit_batches(spark)
    limit_reads(spark)
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    limit_batches(spark)
    limit_reads(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", clean),
    ("quality_classifier", classify),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
