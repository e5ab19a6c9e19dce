"""Raw documents to tokens: the stages of the corpus pipeline, in order.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but
the last return the columns of ``documents``.  ``run`` writes each result to a compressed
table in the shared folder, so that no stage is computed twice or lost with an executor, and
drops it once the next one is there.

Every stage takes a null text for an empty one, works on whole texts of any length and on an
empty table, and passes extra columns through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import bpe_encode
from gridloom.llm.common import Tables
from gridloom.llm.decontaminate import drop_leaks
from gridloom.llm.near_dups import drop_near_duplicates
from gridloom.llm.pii import redact_pii
from gridloom.llm.quality import filter_quality, fit_quality
from gridloom.llm.queries import word_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones outside the held-out fifth.

    Repeated rows are judged alike, a null id is no label's, and an empty text is judged by
    the model's bias; without usable labels every document stays.
    """
    return filter_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of least id.

    Rows equal in id and text are one; rows that repeat an id with other texts are documents
    of their own.  Texts without words and rows with a null id stay.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; repeated rows, empty texts and null ids need no care, and empty items overlap nothing."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.  Repeated rows stay, a null text becomes empty."""
    return redact_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to; a row for each row, an empty text has no ids."""
    return bpe_encode(docs, word_bpe(), ("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The stages learn models and merge components, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, before = Tables(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = tables.keep(docs)
            if before is not None:
                tables.drop(before)
            before = docs
    return docs
