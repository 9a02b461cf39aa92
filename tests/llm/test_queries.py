"""The queries against DuckDB SQL, and the pipeline's stages against their operators."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from holdfast.llm.oracles import SQL
from holdfast.llm.queries import QUERIES

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for file in os.listdir(TINY):
        base.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{TINY}/{file}'")
    expected = base.sql(SQL[name])
    found = QUERIES[name](spark, TINY)
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    order = lambda rows: sorted(rows, key=str)
    theirs = order(expected.select(*columns).fetchall())
    ours = order(tuple(r) for r in found.select(*columns).collect())
    assert ours == theirs


def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, TINY)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        before = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= set(before) and len(ids) == len(set(ids))
        assert len(ids) >= 0.8 * len(before)
        if name == "line dedup":
            assert sorted(ids) == sorted(before)
    final = corpus_pipeline.run(spark, TINY)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(final.columns)
    assert 0 < final.count() <= docs.count()
