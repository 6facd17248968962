"""Registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from feedloom.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.compare import canonical, duck

BASE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    df = LLM_QUERIES[name](spark, BASE)
    cur = duck(BASE).execute(LLM_ORACLES[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(LLM_QUERIES) - set(LLM_ORACLES)))
def test_query_runs(spark, name):
    assert LLM_QUERIES[name](spark, BASE).count() > 0


def test_stages_keep_columns_and_rows_of_the_kept(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, BASE)
        assert docs.columns == names
    assert docs.count() > 100
