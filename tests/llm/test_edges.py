"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import os

import corpus_pipeline
import pytest
from gridloom.llm import bpe, decontaminate, licenses, mixing_lm, near_dups, pii, quality, quality_rules, secrets, token_counts
from gridloom.llm.queries import word_bpe
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick (brown) fox 12 jumps. " * 20_000
ROWS = [
    (None, "a text without an id", "en", "s", 1),
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n", "en", "s", 3),
    (4, LONG, "en", "s", len(LONG)),
    (5, "twice the same row and the same id", "en", "s", 5),
    (5, "twice the same row and the same id", "en", "s", 5),
    (6, "x" * 100_000, "en", "s", 100_000),
    (7, "tied tied tied tied", "en", "s", 7),
    (8, "tied tied tied tied", "en", "s", 8),
]
CLASHING = ("id", "good", "word", "n", "n_tokens", "ids", "score", "spans", "kept", "key", "rep", "component", "license", "w", "g", "t", "h", "row", "item_id", "held_out", "path", "dir")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps the quick brown fox jumps the"), (None, "nothing like it"), (2, None)], "item_id long, text string")


OPERATORS = {
    "pii": lambda s, d: pii.find_pii(d),
    "redact": lambda s, d: pii.redact_pii(d),
    "rules": lambda s, d: quality_rules.apply_quality_rules(d, labels(s)),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "bpe": lambda s, d: bpe.bpe_encode(d, word_bpe(), tuple(bpe.FIELDS)),
    "decode": lambda s, d: bpe.bpe_decode(bpe.bpe_encode(d, word_bpe()).withColumnRenamed("n_tokens", "id"), word_bpe()),
    "counts": lambda s, d: token_counts.count_tokens(d, word_bpe()),
    "quality": lambda s, d: quality.score_quality(d, quality.fit_quality(d, labels(s))),
    "near": lambda s, d: near_dups.find_near_duplicates(d),
    "lm": lambda s, d: mixing_lm.score_documents(d),
    "licenses": lambda s, d: licenses.document_licenses(d),
}
OTHERS = {
    "leaks": lambda s, d: decontaminate.find_leaks(d, bench(s)),
    "no leaks": lambda s, d: decontaminate.drop_leaks(d, bench(s)),
    "filter": lambda s, d: quality.filter_quality(d, quality.fit_quality(d, labels(s))),
    "unique": lambda s, d: near_dups.drop_near_duplicates(d),
}


@pytest.mark.parametrize("name", [*OPERATORS, *OTHERS])
def test_hard_rows_and_clashing_names(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plain = (OPERATORS | OTHERS)[name](spark, docs)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("clash"))
    wide = (OPERATORS | OTHERS)[name](spark, docs)
    got, more = plain.collect(), wide.collect()
    if name in OPERATORS:
        assert len(got) == len(more) == len(ROWS)
    assert len(got) == len(more)
    key = lambda rows: sorted(repr([r[c] for c in plain.columns if c not in CLASHING or plain.columns == wide.columns]) for r in rows)
    assert key(got) == key(more)


@pytest.mark.parametrize("name", [*OPERATORS, *OTHERS])
def test_empty_tables(spark, name):
    out = (OPERATORS | OTHERS)[name](spark, spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.find_near_duplicates(docs).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (7, 1, 7, True), (8, 1, 7, False)} <= near
    assert {x[2:] for x in near if x[0] is None} == {(None, True)}
    lm = {r.doc_id: r for r in mixing_lm.score_documents(docs).collect()}
    assert lm[1].n_tokens == lm[2].n_tokens == 1 and lm[5].n_tokens == 9
    rules = {r.doc_id: r for r in quality_rules.apply_quality_rules(docs, labels(spark)).collect()}
    assert rules[1].base_failed and rules[1].n_words == 0 and rules[4].n_repeat_words == 120_000


def test_stages_on_hard_rows(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.mode("overwrite").parquet(str(tmp_path / f"{len(rows)}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{len(rows)}-{k}"))
            out = stage(spark, docs, str(tmp_path))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
            docs = out
        assert docs.count() <= len(rows)
