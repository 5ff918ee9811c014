"""The corpus pipeline: quality classifier, near-duplicates, decontamination, PII surrogates, byte-level BPE.

Every stage takes whole documents of any length. Null and empty texts are no documents: the quality stage rejects them. A
row of a null doc_id is judged by its text like any other, but is no one's near-duplicate; rows that repeat are judged alike.
All columns pass as they are, whatever their names, but for those a stage names itself. Empty tables stay empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import byte_bpe, decontamination, near_duplicates, pii, quality
from kindred.llm.queries import secret
from kindred.sources.session import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps; null and empty texts and texts without words go."""
    return quality.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near-duplicates. Documents without words are no one's copies.

    Rows that repeat the id which stays all stay, and so do rows of a null id: only ids tell documents apart.
    """
    return near_duplicates.deduplicate(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, exactly or within its edit budget; ids don't matter."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced; n_chars follows the text, null for null. A column n_entities is taken for the operator's own."""
    return pii.pseudonymise(docs, secret(spark)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of ids, their digest and that of the bytes decoded from them; null and empty texts have none."""
    return byte_bpe.code_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("byte_bpe", bpe_stage)]
#: SQL can't express the classifier's estimation and training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next."""
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
