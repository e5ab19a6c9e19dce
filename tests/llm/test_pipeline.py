"""The pipeline against its stages done by plain Python on a small table."""

import os

import corpus_pipeline
import numpy as np
import pytest
from gridloom.llm import decontaminate, pii, quality
from gridloom.llm.queries import ORACLE_SQL, QUERIES, word_bpe
from tests.llm.test_operators import components_brute, shingle_sets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_pipeline_equals_plain_python(spark):
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weights, bias = quality.fit_quality(docs, labels)
    hasher = quality.Hasher()
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {d: t for d, t in texts.items() if 1 / (1 + np.exp(-quality.dot(weights, bias, hasher.features(t)))) >= 0.3}
    top = components_brute(shingle_sets(left, 5))
    left = {d: t for d, t in left.items() if top[d] == d}
    seeds = decontaminate.Seeds.build([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    numbers = decontaminate.WordNumbers()
    left = {d: t for d, t in left.items() if not seeds.found(numbers.of(t), 10, 0.7)}
    field = pii.trained()
    left = {d: pii.redact_text(t, pii.all_spans(t, pii.base_spans(t), field)) for d, t in left.items()}
    library = Tokenizer.from_file(word_bpe())
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in left.items()}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(want) < len(texts)


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(QUERIES) <= set(names) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "tokens"]
