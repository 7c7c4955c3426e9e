"""The pipeline on the test tables: its stages keep the columns of documents and drop few rows. Brute force: test_queries.py."""

import os

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= before and (name != "line_dedup" or after == before)
        before, docs = after, corpus_pipeline.materialize(out, name)
    last = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert last == before
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == before
    assert 0.7 * 200 <= len(before) <= 200


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"none-{name}")
        assert docs.count() == 0
