"""Stages of the pipeline on odd rows: each takes any table of documents and leaves its columns alone."""

import corpus_pipeline
import pytest
from pulseloom.session import materialize
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, odd_docs, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    given = materialize(odd_docs)
    out = stage(spark, given, SF)
    if name != "encoding":
        assert out.columns == given.columns
        left = out.groupBy("doc_id").count()
        had = given.groupBy("doc_id").agg(F.count(F.lit(1)).alias("had"))
        assert left.join(had, "doc_id", "left_anti").filter("doc_id is not null").isEmpty()
    else:
        assert out.count() == given.count()
    if name == "near copies":  # one of the two equal rows stays; rows without words or id all do
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.select("doc_id").collect() if r["doc_id"]) == [(False, i) for i in range(1, 8)]
        assert out.filter("doc_id is null").count() == 1
    assert stage(spark, no_docs, SF).count() == 0
