"""Stream pipelines.  Every batch function may be replayed after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.alerts import STORE_SCHEMA, announce, cap_store, new_alerts
from feedloom.operators.items import critical_only, identity_key
from feedloom.operators.snapshots import delete_keys, evicted_channel_keys, upsert
from feedloom.session import cut_lineage
from feedloom.sources.buckets import BucketTable
from feedloom.sources.costs import judged_costs, with_cost_defaults
from feedloom.sources.snapshots import SnapshotTable
from feedloom.sources.topics import ITEM_EXPIRY_HOURS, POLL_MINUTES
from feedloom.streaming.state import first_of_session


def poll_trigger(panel: str = "default", once: bool = False) -> dict:
    """Trigger arguments for a panel's refresh cadence; ``once`` drains and stops."""
    if once:
        return {"availableNow": True}
    return {"processingTime": f"{POLL_MINUTES.get(panel, POLL_MINUTES['default'])} minutes"}


def force_once(requests: DataFrame, **session) -> DataFrame:
    """First request per session, panel and topic; a new session starts over.

    ``session`` says how sessions end: see ``first_of_session``.
    """
    return first_of_session(requests, **session)


def late_item_cleanup(
    items: DataFrame, ts: str = "ts", hours: int = ITEM_EXPIRY_HOURS, by: tuple[str, ...] = ()
) -> DataFrame:
    """Drop repeats inside the event-time watermark, within each feed that ``by`` names.

    Items behind the watermark go too.  An item without identity repeats nothing
    and is always kept.
    """
    keyed = items.withColumn("identity", identity_key(F.col("url"), F.col("title"), F.col("body")))
    blank = F.coalesce(F.col("identity"), F.lit("")) == ""
    known = keyed.filter(~blank).withWatermark(ts, f"{hours} hours")
    return known.dropDuplicatesWithinWatermark([*by, "identity"]).unionByName(keyed.filter(blank))


def cost_sink(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append priced calls to the cost log; exactly once, by the file sink's log."""
    return (
        with_cost_defaults(rows)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or poll_trigger()))
        .start()
    )


def safe_cost_sink(rows: DataFrame, path: str, rejected: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Cost rows as callers send them: good ones to the log, the others aside with a reason.

    Every column may come as text or be missing. Each batch owns a folder in both
    places, so a replay writes the same again.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_costs(batch, path, rejected, batch_id)

    return (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or poll_trigger()))
        .start()
    )


def write_costs(batch: DataFrame, path: str, rejected: str, batch_id: int) -> None:
    judged = cut_lineage(judged_costs(batch))
    good = with_cost_defaults(judged.filter("reason is null").drop("reason", "received"))
    good.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
    bad = judged.filter("reason is not null").select("reason", "received")
    bad.write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/batch={batch_id}")


class AlertStore:
    """Stored notifications, one small parquet folder per batch.

    A batch reads the newest folder older than itself, so replaying a batch
    reads the same input and overwrites the same output.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _last(self, below: int | None = None) -> int | None:
        """Newest committed batch, if asked below a given one."""
        try:
            commits = self.spark.read.schema("batch_id BIGINT").parquet(f"{self.path}/commits")
        except AnalysisException:
            return None
        if below is not None:
            commits = commits.filter(F.col("batch_id") < below)
        return commits.agg(F.max("batch_id")).first()[0]

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(STORE_SCHEMA).parquet(f"{self.path}/{folder}")

    def _store(self, batch_id: int | None) -> DataFrame:
        if batch_id is None:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self._read(f"store/batch={batch_id}")

    def latest(self) -> DataFrame:
        """The stored notifications now."""
        return self._store(self._last())

    def added(self) -> DataFrame:
        """Everything ever reported as new."""
        return self._read("added/*")

    def advance(self, batch: DataFrame, batch_id: int, now_iso: str) -> DataFrame:
        """Apply one update; returns the rows it reported as new."""
        stored = self._store(self._last(below=batch_id))
        new_alerts(batch, stored, batch_id, now_iso).write.mode("overwrite").parquet(
            f"{self.path}/added/batch={batch_id}"
        )
        added = self._read(f"added/batch={batch_id}")
        cap_store(added, stored).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/store/batch={batch_id}")
        commit = self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"))
        commit.write.mode("append").parquet(f"{self.path}/commits")
        return added


def alert_stream(
    items: DataFrame,
    store: AlertStore,
    checkpoint: str,
    now_iso: Callable[[int], str],
    on_announce: Callable[[DataFrame, int], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Critical items not yet stored become alerts.

    ``now_iso`` maps a batch id to its timestamp, so a replay stamps the same
    time; ``on_announce`` receives the few alerts of a batch worth showing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = critical_only(batch).select("pos", F.col("title").alias("headline"), "url")
        added = store.advance(rows, batch_id, now_iso(batch_id))
        if on_announce is not None:
            on_announce(announce(added), batch_id)

    return (
        items.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or poll_trigger()))
        .start()
    )


def snapshot_sink(changes: DataFrame, table: SnapshotTable | BucketTable, checkpoint: str, name: str = "sink", **trigger) -> StreamingQuery:
    """Keep-latest upsert per batch into the snapshot table.

    A table in buckets rewrites the touched ones only, knows a replayed batch by the
    sink's ``name``, and may have several sinks.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if isinstance(table, BucketTable):
            table.upsert(batch, name, batch_id)
        else:
            table.write(upsert(table.read(), batch))

    return (
        changes.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or poll_trigger()))
        .start()
    )


def evict_stale_feed(table: SnapshotTable, newest: DataFrame, now) -> int:
    """Publish the table without the channel snapshots, if any of them is stale."""
    store = table.read()
    return table.write(delete_keys(store, evicted_channel_keys(store, newest, now)))
