"""The registered queries of the document operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.bpe import bpe_encode
from gridloom.llm.common import documents
from gridloom.llm.decontaminate import find_leaks
from gridloom.llm import licenses, quality_rules
from gridloom.llm.licenses import document_licenses
from gridloom.llm.mixing_lm import score_documents
from gridloom.llm.near_dups import find_near_duplicates
from gridloom.llm.pii import find_pii
from gridloom.llm.quality import fit_quality, score_quality
from gridloom.llm.quality_rules import apply_quality_rules
from gridloom.llm.secrets import ranks, scan_secrets
from gridloom.llm.token_counts import count_tokens


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op2_importance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return apply_quality_rules(documents(spark, sf_dir), trusted)


def op3_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir), words=ranks(word_bpe()))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(documents(spark, sf_dir), word_bpe(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_resync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), word_bpe())


def op8_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, fit_quality(docs, labels))


def op9_fast_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(documents(spark, sf_dir), width=4)


def op10_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licenses(documents(spark, sf_dir))


QUERIES = {
    "op1_pii_semi_markov": op1_pii_semi_markov,
    "op2_importance_ratio": op2_importance_ratio,
    "op3_secret_guess_cost": op3_secret_guess_cost,
    "op4_bpe_trie": op4_bpe_trie,
    "op5_context_mixing": op5_context_mixing,
    "op6_spaced_seeds": op6_spaced_seeds,
    "op7_resync_counts": op7_resync_counts,
    "op8_quality_ftrl": op8_quality_ftrl,
    "op9_fast_similarity": op9_fast_similarity,
    "op10_license_tfidf": op10_license_tfidf,
}

ORACLE_SQL: dict[str, str] = {
    "op2_importance_ratio": quality_rules.ORACLE,
    "op10_license_tfidf": licenses.ORACLE,
}
