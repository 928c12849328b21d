import re
from collections import Counter

import corpus_pipeline as P
import pytest

from helixframe.llm.bpe import decode_tokens

QUERIES = ["op1_quality_rules", "op2_quality_classifier", "op3_byte_bpe", "op4_media_ogg", "op5_token_counts", "op6_suffix_dedup", "op7_mixing", "op8_simhash", "op9_pii", "op10_language_id", "pipeline"]


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES[:-1])
def test_queries_return_every_document(spark, sf, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count() and got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_one_by_one(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(docs)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
    rules, near, pii, mix, tokens = [s.collect() for s in steps]
    assert 0 < len(near) < len(rules) and len(pii) == len(near)
    assert all(r["n_chars"] == len(r["text"]) for r in pii)
    assert not any(re.search(r"[\w.]+@[\w-]+\.\w", r["text"]) for r in pii)
    copies = Counter(r["doc_id"] for r in mix)
    assert set(copies) <= {r["doc_id"] for r in pii} and max(copies.values()) <= 2
    assert len(tokens) == len(mix) and all(r["decoded_ok"] for r in tokens)
    text_of = {r["doc_id"]: r["text"] for r in pii}
    assert all(r["decoded_text"] == text_of[r["doc_id"]] for r in decode_tokens(steps[-1]).collect())


def test_run_is_the_stages(spark, sf):
    got = P.run(spark, sf)
    again = P.run(spark, sf)
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(got) == key(again) != []


def test_stages_of_an_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(docs.schema if k < 4 else stage(spark, docs, sf).schema).parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
