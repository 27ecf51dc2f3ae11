"""The pipeline's stages on a small table, each against what its operator says of its input."""

from __future__ import annotations

import corpus_pipeline
from zealmark.llm.decontaminate import find_benchmark
from zealmark.llm.jaccard_join import near_duplicates
from zealmark.session import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES:
        before, docs = docs, stage(apply(spark, docs, SF), "stage")
        if name == "token files":
            assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and docs.count() == before.count()
            continue
        assert docs.columns == columns and docs.count() > 0
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "near duplicates":
            assert near_duplicates(docs).where("doc_id <> component_id").count() == 0
        if name == "decontaminate":
            assert find_benchmark(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    assert docs.count() > 0
