"""The bucketed snapshot table and the cost sink under replays, rivals and bad rows."""

from __future__ import annotations

import threading
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feedloom.sources.buckets import COLUMNS, BucketTable
from feedloom.sources.snapshots import SCHEMA
from feedloom.streaming import jobs
from tests.test_streams import ONCE, batches

START = datetime(2024, 1, 1)


def row(key, body, minute=0):
    at = START + timedelta(minutes=minute)
    return (key, body, at.isoformat(), at)


def rows_of(table, **kw):
    return {r.function_name: r.response_data for r in table.read(**kw).collect()}


@pytest.fixture()
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "table"), buckets=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_upsert_and_delete_keep_the_latest(spark, table):
    assert rows_of(table) == {} and table.read().columns == list(COLUMNS)
    first = table.upsert(frame(spark, [row(f"k{i}", "old", i) for i in range(40)]))
    table.upsert(frame(spark, [row("k1", "later", 5), row("k1", "new", 9), row("k2", "earlier than stored", -5), row("k99", "x")]))
    want = {f"k{i}": "old" for i in range(40)} | {"k1": "new", "k2": "earlier than stored", "k99": "x"}
    assert rows_of(table) == want and table.read().count() == 41
    assert rows_of(table, keys=["k1", "k7", "none"]) == {"k1": "new", "k7": "old"}
    table.delete(spark.createDataFrame([("k1",), ("none",)], "function_name STRING"))
    del want["k1"]
    assert rows_of(table) == want
    table.delete(table.read().select("function_name"))
    assert rows_of(table) == {}
    assert rows_of(table, version=first) == {f"k{i}": "old" for i in range(40)}


def test_bytes_written_follow_the_change(spark, table):
    table.upsert(frame(spark, [row(f"k{i}", f"{i} " * 5000) for i in range(80)]))
    whole = table.files.size("data")
    before = table.manifest()
    table.upsert(frame(spark, [row("k3", "small")]))
    after = table.manifest()
    changed = [b for b in after.folders if after.folders[b] != before.folders[b]]
    assert len(changed) == 1
    assert table.files.size("data") - whole < whole / 3
    table.upsert(frame(spark, []))
    assert table.manifest().folders == after.folders


def test_replayed_batch_changes_nothing(spark, table):
    table.upsert(frame(spark, [row("a", "1")]), "w", 0)
    table.upsert(frame(spark, [row("a", "2")]), "w", 1)
    version = table.upsert(frame(spark, [row("a", "again")]), "w", 1)
    assert table.upsert(frame(spark, [row("a", "older")]), "w", 0) == version == table.manifest().version == 2
    assert rows_of(table) == {"a": "2"}
    assert table.upsert(frame(spark, [row("b", "other writer")]), "v", 0) == 3


def test_two_writers_lose_nothing(spark, table):
    """Writers of the same buckets at once: every batch of both is in the result."""

    def write(name):
        for n in range(4):
            table.upsert(frame(spark, [row(f"{name}{i}", str(n), n) for i in range(12)]), name, n)

    threads = [threading.Thread(target=write, args=(name,)) for name in "xy"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert rows_of(table) == {f"{name}{i}": "3" for name in "xy" for i in range(12)}
    manifest = table.manifest()
    assert manifest.batches == {"x": 3, "y": 3} and manifest.version == 8
    assert table.files.names("staged") == []


def test_unfinished_commit_is_no_version(spark, table):
    table.upsert(frame(spark, [row("a", "1")]))
    table.files.create("versions/000000000002", '{"folders": {')
    assert rows_of(table) == {"a": "1"}
    assert table.upsert(frame(spark, [row("b", "2")])) == 3 and rows_of(table) == {"a": "1", "b": "2"}


def test_old_folders_go(spark, table):
    for n in range(5):
        table.upsert(frame(spark, [row("a", str(n), n)]))
    held = table.read(version=table.manifest().version - 1)
    assert table.expire(keep=2, hours=1) == []
    assert len(table.expire(keep=2, hours=0)) == 3 and len(table.files.names("data")) == 2
    assert rows_of(table) == {"a": "4"} and held.first().response_data == "3"


def test_sink_into_buckets(spark, table, tmp_path):
    groups = [[row("a", "1"), row("b", "1")], [row("a", "2", 1)], [row("c", "3", 2)]]
    stream = batches(spark, tmp_path / "in", groups, SCHEMA)
    jobs.snapshot_sink(stream, table, str(tmp_path / "cp"), "feed", **ONCE).awaitTermination()
    assert rows_of(table) == {"a": "2", "b": "1", "c": "3"} and table.manifest().batches == {"feed": 2}


SENT = "panel STRING, provider STRING, units STRING, cost_usd STRING, cache_hit STRING, created_at STRING, note STRING"


def test_cost_sink_sets_bad_rows_aside(spark, tmp_path):
    at = "2024-01-01T00:00:00Z"
    groups = [
        [("news", "scraper", None, "0.0015", None, at, "x"), ("news", "scraper", "two", "1", None, at, "x"), (" ", "scraper", "1", "1", None, at, "x")],
        [("news", None, "1", "1", None, at, "x"), ("news", "model", "2", "-1", None, at, "x"), ("news", "model", "1", "9", "true", at, None), ("news", "model", "1", "1", "maybe", "yesterday", "x"), ("news", "model", "1", "1", None, None, "x")],
    ]
    stream = batches(spark, tmp_path / "in", groups, SENT)
    log, aside = str(tmp_path / "log"), str(tmp_path / "aside")
    jobs.safe_cost_sink(stream, log, aside, str(tmp_path / "cp"), **ONCE).awaitTermination()

    def seen():
        good = sorted(tuple(r) for r in spark.read.parquet(log).select("provider", "units", "cost_usd", "cache_hit").collect())
        return good, sorted(r.reason for r in spark.read.parquet(aside).collect())

    want = [("model", Decimal(1), Decimal(0), True), ("scraper", Decimal(1), Decimal("0.0015"), False)]
    reasons = ["cache_hit is not a boolean", "cost_usd is negative", "created_at is missing", "panel is missing", "provider is missing", "units is not a decimal(18,6)"]
    assert seen() == (want, reasons)
    received = spark.read.parquet(aside).filter("reason like 'units%'").select(F.get_json_object("received", "$.units")).first()[0]
    assert received == "two"
    jobs.write_costs(spark.createDataFrame(groups[1], SENT), log, aside, 1)  # a replay
    assert seen() == (want, reasons)
