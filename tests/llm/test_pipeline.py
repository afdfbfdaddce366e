from __future__ import annotations

import re

import corpus_pipeline
from sundew.llm import registry


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns, name
        assert docs.count() > 0
        if name != "mixture":
            assert docs.count() <= n
            n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()


def test_empty_documents_pass_through(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 0


def test_registry_names_every_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries() if n != "pipeline")
    assert numbers == list(range(1, 11)) and "pipeline" in registry.queries()
