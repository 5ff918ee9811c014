"""Thin queries over the operators of this package, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.session import scratch
from . import byte_bpe, decontamination, embedding_links, lm_score, near_duplicates, pii, quality, secrets, token_files, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession) -> str:
    """The key of surrogates: spark.kindred.secret of the session. Without it a known one is used, which keeps nothing secret: for tests."""
    return spark.conf.get("spark.kindred.secret", None) or "no secret was set"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark))


def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.embedding_links(_table(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.code_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256")
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, folder, manifest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_pii": op2_pii,
    "op3_lm_score": op3_lm_score,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_embedding_links": op7_embedding_links,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_files": op10_token_files,
}
ORACLES: dict[str, str] = {
    "op3_lm_score": lm_score.oracle(),
    "op4_secrets": secrets.oracle(),
    "op6_url_filter": url_filter.oracle(),
    "op7_embedding_links": embedding_links.oracle(),
    "op8_near_duplicates": near_duplicates.oracle(),
}
