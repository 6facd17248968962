"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedloom.operators import items as it
from feedloom.operators.topics import relevance
from feedloom.registry import QUERIES
from feedloom.sources.topics import topic_config

BASE = "/root/testdata/sf0.001"
PYTHON_STEPS = {"norm_name", "roster_match", "analyst_feed"}
EAGER = {"timeline", "timeline_dedupe", "title_pairs", "alert_replay", "cost_stream", "stream_cleanup", "snapshot_scan"}


def plan(spark, name):
    return QUERIES[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert ("ArrowEvalPython" in text) == (name in PYTHON_STEPS)


@pytest.mark.parametrize("name", ["topk_news", "latest_messages", "source_slice", "dedupe_identity", "corpus_by_topic"])
def test_rank_filters_are_limited_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_few_topics_do_not_shuffle_the_large_side(spark):
    """Even where Spark itself would broadcast nothing."""
    config = topic_config(spark)
    rows = spark.read.parquet(f"{BASE}/events.parquet").select(
        F.col("event_type").alias("conflict"), F.col("event_type").alias("severity"), F.col("event_type").alias("body"),
        F.lit("2024-01-01T00:00:00Z").alias("ts_raw"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [it.in_date_range(rows, config, "2024-02-01"), it.urgent_or_all(rows), relevance(rows, config, "body")]
        texts = [df._jdf.queryExecution().executedPlan().toString() for df in frames] + [plan(spark, "priced_calls")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for text in texts:
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "ShuffledHashJoin" not in text


def test_scans_read_only_what_is_needed(spark):
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan(spark, "conflict_norm")
    # Alerts are judged by the severity of every event, so no filter on its type reaches the scan.
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan(spark, "alert_cap")
    assert "PushedFilters: [In(function_name, " in plan(spark, "snapshot_scan")


def test_names_are_resolved_without_reading_comments_again(spark):
    """Comments are parsed for their names and for the result, not for each use of the names."""
    assert plan(spark, "analyst_feed").count("FileScan parquet [event_id#") == 1
    assert plan(spark, "roster_match").count("FileScan parquet [l_partkey#") == 1
