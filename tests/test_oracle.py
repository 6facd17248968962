"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import os

import pytest

from feedloom.registry import ORACLES, QUERIES
from tests.compare import duck, run_both

BASE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(BASE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ours, theirs = run_both(spark, con, name, BASE)
    assert ours[1], "a query must return rows"
    if theirs is not None:
        assert ours == theirs


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["conflict", "pos", "ts_raw", "title"]
    assert df.count() > 0
