"""Notifications: what is new, what is kept, what is announced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import http_url_or_null, trimmed
from feedloom.sources.topics import ANNOUNCED_ALERTS, STORED_ALERTS

STORE_SCHEMA = "batch BIGINT, pos BIGINT, headline STRING, url STRING, added_at STRING, is_read BOOLEAN"


def first_of_each(batch: DataFrame) -> DataFrame:
    """First row of each trimmed headline, blanks dropped: a partial aggregate."""
    rest = [c for c in batch.columns if c not in ("headline", "pos")]
    return (
        batch.withColumn("headline", trimmed(F.col("headline")))
        .filter(F.col("headline") != "")
        .groupBy("headline")
        .agg(F.min_by(F.struct("pos", *rest), "pos").alias("first"))
        .select("headline", "first.*")
    )


def anti_seen(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Headlines that are neither stored nor earlier in the batch."""
    seen = store.select(trimmed(F.col("headline")).alias("headline"))
    return first_of_each(batch).join(seen, "headline", "left_anti")


def load_notifications(table: DataFrame, cap: int = STORED_ALERTS) -> DataFrame:
    """Stored notifications: blank headlines dropped, newest ``cap`` rows."""
    return table.filter(trimmed(F.col("headline")) != "").orderBy(F.desc("batch"), "pos").limit(cap)


def cap_store(added: DataFrame, store: DataFrame, cap: int = STORED_ALERTS) -> DataFrame:
    """New rows first, then the old ones, cut at ``cap``."""
    return added.unionByName(store).orderBy(F.desc("batch"), "pos").limit(cap)


def announce(added: DataFrame, cap: int = ANNOUNCED_ALERTS, group: str | None = None) -> DataFrame:
    """The first few new alerts of an update (of each ``group``, if named)."""
    if group is None:
        return added.orderBy("pos").limit(cap)
    w = Window.partitionBy(group).orderBy("pos")
    return added.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).drop("rank")


def new_alerts(batch: DataFrame, store: DataFrame, batch_id: int, now_iso: str) -> DataFrame:
    """Store rows for what an update brings that is new.

    The store is at most ``STORED_ALERTS`` rows, so the anti-join broadcasts it.
    """
    return anti_seen(batch.select("pos", "headline", "url"), store).select(
        F.lit(batch_id).cast("bigint").alias("batch"),
        "pos",
        "headline",
        http_url_or_null(F.col("url")).alias("url"),
        F.lit(now_iso).alias("added_at"),
        F.lit(False).alias("is_read"),
    )


def apply_commands(notifications: DataFrame, commands: DataFrame) -> DataFrame:
    """Rows up to the last ``clear`` go; rows up to the last ``mark_read`` are read.

    ``commands`` is ``(command, at)``; only its two maxima are needed,
    as scalar subqueries.
    """
    def last(command: str) -> Column:
        return commands.filter(F.col("command") == command).agg(F.max("at")).scalar()

    cleared, marked = last("clear"), last("mark_read")
    return notifications.filter(F.coalesce(F.col("added_at") > cleared, F.isnull(cleared))).withColumn(
        "is_read", F.col("is_read") | F.coalesce(F.col("added_at") <= marked, F.lit(False))
    )


def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.agg(F.count_if(~F.col("is_read")).alias("unread"))
