"""Streams drained in several micro-batches against their batch meaning."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from feedloom.operators import snapshots as sn
from feedloom.sources.snapshots import SnapshotTable
from feedloom.streaming import jobs

ONCE = jobs.poll_trigger(once=True)
ITEM = "pos BIGINT, title STRING, severity STRING, url STRING, body STRING, ts TIMESTAMP"
START = datetime(2024, 1, 1)


def batches(spark, folder, groups, schema):
    """One parquet file per micro-batch, read back as a stream in order."""
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
    # Files are taken oldest first, one per trigger.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def item(pos, title, severity="critical", hours=0, url=None):
    return (pos, title, severity, url, None, START + timedelta(hours=hours))


def loop(groups, cap=50):
    """The stored list, one update after the other."""
    store, added = [], []
    for batch_id, rows in enumerate(groups):
        seen, fresh = set(store), []
        for row in rows:
            name = row[1].strip()
            if row[2] == "critical" and name and name not in seen:
                seen.add(name)
                fresh.append(name)
        added += [(batch_id, n) for n in fresh]
        store = (fresh + store)[:cap]
    return store, added


def test_alert_stream_forgets_evicted_headlines(spark, tmp_path):
    groups = [
        [item(i, f"head {i}") for i in range(30)],
        [item(i, f"head {i + 20} ") for i in range(40)] + [item(99, "calm", "info")],
        [item(0, "head 25"), item(1, "head 59"), item(2, " head 25"), item(3, " ")],
    ]
    stream = batches(spark, tmp_path / "in", groups, ITEM)
    store = jobs.AlertStore(spark, str(tmp_path / "store"))
    shown = {}
    stamp = lambda b: f"T{b}"
    announce = lambda df, b: shown.__setitem__(b, [r.headline for r in df.collect()])
    jobs.alert_stream(stream, store, str(tmp_path / "cp"), stamp, announce, **ONCE).awaitTermination()

    want_store, want_added = loop(groups)
    assert "head 25" in [h for b, h in want_added if b == 2], "an evicted headline alerts again"
    assert sorted((r.batch, r.headline) for r in store.added().collect()) == sorted(want_added)
    kept = store.latest().orderBy(F.desc("batch"), "pos").collect()
    assert [r.headline for r in kept] == want_store
    assert shown == {0: ["head 0", "head 1", "head 2"], 1: ["head 30", "head 31", "head 32"], 2: ["head 25"]}

    # A replayed batch finds the same input and writes the same output.
    rows = spark.createDataFrame(groups[2], ITEM).filter("severity = 'critical'").select("pos", F.col("title").alias("headline"), "url")
    store.advance(rows, 2, "T2")
    assert sorted((r.batch, r.headline) for r in store.added().collect()) == sorted(want_added)
    assert [r.headline for r in store.latest().orderBy(F.desc("batch"), "pos").collect()] == want_store


def test_cleanup_stream_keeps_one_row_per_identity(spark, tmp_path):
    groups = [
        [item(0, "A b"), item(1, "c", hours=1), item(2, "a  B", hours=2)],
        [item(3, "C ", hours=3), item(4, "d", hours=100)],
        [item(6, "D", hours=101), item(7, "e", hours=99)],
        [item(5, "late", hours=5), item(8, "E", hours=102)],
    ]
    stream = batches(spark, tmp_path / "in", groups, ITEM)
    out = str(tmp_path / "out")
    jobs.late_item_cleanup(stream).select("identity").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start().awaitTermination()
    # "late" is more than 48 hours behind the watermark known when its batch began.
    assert sorted(r.identity for r in spark.read.parquet(out).collect()) == ["a b", "c", "d", "e"]


def test_force_once_per_session(spark, tmp_path):
    schema = "session STRING, panel STRING, conflict STRING, n INT"
    groups = [[("s1", "news", "all", 1), ("s1", "osint", "all", 2)], [("s1", "news", "all", 3), ("s2", "news", "all", 4)]]
    stream = batches(spark, tmp_path / "in", groups, schema)
    out = str(tmp_path / "out")
    jobs.force_once(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start().awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 2, 4]


def test_cost_sink_fills_defaults(spark, tmp_path):
    schema = "panel STRING, provider STRING, cost_usd DECIMAL(18,6), cache_hit BOOLEAN, created_at TIMESTAMP"
    from decimal import Decimal

    groups = [[("news", "scraper", Decimal("0.0015"), None, START)], [("news", "scraper", Decimal("9"), True, START)]]
    stream = batches(spark, tmp_path / "in", groups, schema)
    jobs.cost_sink(stream, str(tmp_path / "log"), str(tmp_path / "cp"), **ONCE).awaitTermination()
    rows = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).select("units", "unit_type", "cost_usd", "cache_hit").collect())
    assert rows == [(1, "request", 0, True), (1, "request", Decimal("0.001500"), False)]


def test_snapshot_sink_and_eviction(spark, tmp_path):
    def row(key, body, minutes):
        at = datetime(2024, 1, 31) - timedelta(minutes=minutes)
        return (key, body, at.isoformat(), at)

    schema = "function_name STRING, response_data STRING, cached_at STRING, fetched_at TIMESTAMP"
    fresh = '{"messages":[{"timestamp":"2024-01-30T23:30:00Z"}]}'
    old = '{"messages":[{"timestamp":"2024-01-30T20:00:00Z"}]}'
    groups = [
        [row("telegram-feed:all", old, 90), row("firecrawl-news:all", "{}", 90)],
        [row("telegram-feed:all", fresh, 30), row("telegram-feed:iran-us", fresh, 30)],
    ]
    table = SnapshotTable(spark, str(tmp_path / "table"))
    assert table.read().count() == 0
    stream = batches(spark, tmp_path / "in", groups, schema)
    jobs.snapshot_sink(stream, table, str(tmp_path / "cp"), **ONCE).awaitTermination()
    got = {r.function_name: r.response_data for r in table.read().collect()}
    assert got == {"telegram-feed:all": fresh, "telegram-feed:iran-us": fresh, "firecrawl-news:all": "{}"}
    assert [r.function_name for r in table.read(["telegram-feed:all"]).collect()] == ["telegram-feed:all"]

    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    newest = lambda: sn.explode_snapshots(table.read()).groupBy("function_name").agg(F.max("ts_raw").alias("newest"))
    jobs.evict_stale_feed(table, newest(), now)
    assert table.read().count() == 3
    table.write(sn.upsert(table.read(), spark.createDataFrame([row("telegram-feed:china-taiwan", old, 1)], schema)))
    jobs.evict_stale_feed(table, newest(), now)
    assert [r.function_name for r in table.read().collect()] == ["firecrawl-news:all"]


def test_audit_publishes_next_version(spark, tmp_path):
    from feedloom.plans.audit import run_audit

    schema = "function_name STRING, response_data STRING, cached_at STRING, fetched_at TIMESTAMP"
    table = SnapshotTable(spark, str(tmp_path / "table"))
    table.write(spark.createDataFrame([("old:x", "{}", "2024-01-30T23:00:00Z", START), ("firecrawl-news", "{}", "2024-01-30T23:00:00Z", START)], schema))
    report = run_audit(table, F.lit("2024-01-31 00:00:00").cast("timestamp")).first()
    assert report.deleted_orphaned == 1 and table.version() == 2
    assert [r.function_name for r in table.read().collect()] == ["firecrawl-news"]
