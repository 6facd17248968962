"""Keyed state of the streams: notifications, sessions, first items.

Each processor handles the rows of one key of a micro-batch in event order, so the
rows may arrive in any order inside it. Keys are spread over the cluster; what a key
remembers is bounded (fifty alerts, the panels of a session, one item).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from feedloom.functions.text import http_url_or_null, trimmed
from feedloom.operators.items import identity_key
from feedloom.sources.topics import ANNOUNCED_ALERTS, ITEM_EXPIRY_HOURS, STORED_ALERTS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SESSION_HOURS = 12
ALERT, MARK_READ, CLEAR = "alert", "mark_read", "clear"
STORED = "at STRING, batch BIGINT, pos BIGINT, headline STRING, url STRING, is_read BOOLEAN"
NOTES = f"owner STRING, event STRING, version BIGINT, place INT, {STORED}"
NOTE = Row(*(c.split()[0] for c in NOTES.split(", ")))


def stateful(spark: SparkSession) -> SparkSession:
    """Keyed state needs the store that can hold several variables of a key."""
    spark.conf.set(PROVIDER, ROCKS)
    return spark


_ARRIVED = pa.schema([("at", pa.string()), ("kind", pa.string()), ("batch", pa.int64()), ("pos", pa.int64()), ("headline", pa.string()), ("url", pa.string())])
# Rows that are turned into columns, or back, at a time.
_ROWS = 4096


def _columns(rows: Iterator[Row], schema: pa.Schema) -> pa.Table:
    """Rows as columns, each in one piece; the pieces of a column go before the next is joined."""
    parts: list[list[pa.Array]] = [[] for _ in schema]
    while some := list(islice(rows, _ROWS)):
        for part, field in zip(parts, schema):
            part.append(pa.array([r[field.name] for r in some], field.type))
    return pa.table([pa.concat_arrays(parts.pop(0)) for _ in schema], schema=schema)


def _updates(got: pa.Table) -> Iterator[tuple[str, str, Iterator[dict]]]:
    """``at, kind, rows`` in event order: the alerts of one time together, by position, before commands of that time."""
    order = pc.sort_indices(got, [(c, "ascending") for c in ("at", "kind", "pos")])  # the names sort as alert, clear, mark_read
    rows = (r for i in range(0, len(order), _ROWS) for r in got.take(order[i : i + _ROWS]).to_pylist())
    for (at, kind), some in groupby(rows, key=lambda r: (r["at"], r["kind"])):
        yield at, kind, some


class Notifications(StatefulProcessor):
    """The last alerts of an owner, under commands that mark them read or clear them.

    Alerts of one time are one update: headlines that are stored or came earlier in it
    are no news; the new ones go before the stored ones, and the store is cut. A
    command holds for alerts up to its time, whenever it arrives.
    """

    def __init__(self, cap: int = STORED_ALERTS, announced: int = ANNOUNCED_ALERTS):
        self.cap, self.announced = cap, announced

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getListState("stored", STORED)
        self.marks = handle.getValueState("marks", "version BIGINT, cleared STRING, marked STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        store = [tuple(r) for r in self.stored.get()] if self.stored.exists() else []
        version, cleared, marked = self.marks.get() if self.marks.exists() else (0, None, None)
        version += 1
        # What a key gets in a micro-batch is held as columns: rows would take many times the memory.
        for at, kind, update in _updates(_columns(rows, _ARRIVED)):
            if kind == MARK_READ:
                marked = max(marked or at, at)
            elif kind == CLEAR:
                cleared = max(cleared or at, at)
                store = [s for s in store if s[0] > cleared]
            elif cleared is None or at > cleared:
                seen = {s[3] for s in store}
                place = 0
                fresh = []
                for r in update:
                    if r["headline"] in seen:
                        continue
                    # Sorted by position: a headline's first row of the update stands for it.
                    seen.add(r["headline"])
                    note = (at, r["batch"], r["pos"], r["headline"], r["url"], False)
                    yield self._row(key, "announced" if place < self.announced else "added", version, place, note)
                    if place < self.cap:
                        fresh.append(note)
                    place += 1
                store = self._ordered(fresh + store)[: self.cap]
        if marked is not None:
            store = [(*s[:5], s[5] or s[0] <= marked) for s in store]
        self.stored.put(store) if store else self.stored.clear()
        self.marks.update((version, cleared, marked))
        for place, s in enumerate(store):
            yield self._row(key, "stored", version, place, s)
        if not store:
            yield self._row(key, "emptied", version, -1, (None,) * 6)

    @staticmethod
    def _ordered(rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda s: s[0], reverse=True)  # stable: newest update first

    @staticmethod
    def _row(key, event: str, version: int, place: int, stored: tuple) -> Row:
        return NOTE(key[0], event, version, place, *stored)

    def close(self) -> None:
        pass


def notifications(alerts: DataFrame, commands: DataFrame | None = None, **limits: int) -> DataFrame:
    """Stream of what happens to each owner's notifications: see ``NOTES``.

    ``alerts`` is ``(owner, at, batch, pos, headline, url)``, ``commands`` ``(owner, at,
    kind)``. ``event`` is announced or added (new alerts, the first few of an update are
    announced), and stored or emptied: the whole store after a micro-batch, by
    ``version`` and ``place``.
    """
    stateful(alerts.sparkSession)
    rows = alerts.select(
        "owner", "at", F.lit(ALERT).alias("kind"), "batch", "pos", trimmed(F.col("headline")).alias("headline"), http_url_or_null(F.col("url")).alias("url")
    ).filter("headline <> ''")
    if commands is not None:
        rows = rows.unionByName(commands.select("owner", "at", "kind"), allowMissingColumns=True)
    return rows.groupBy("owner").transformWithState(Notifications(**limits), NOTES, "Append", "None")


def current_notifications(notes: DataFrame) -> DataFrame:
    """The store of every owner after its last version, from the written rows."""
    states = notes.filter(F.col("event").isin("stored", "emptied"))
    last = states.groupBy("owner").agg(F.max("version").alias("version"))
    return states.join(last, ["owner", "version"]).filter("event = 'stored'").drop("event", "version")


class FirstOfSession(StatefulProcessor):
    """Lets the first request of a session for each choice pass, until the session ends.

    A row whose ``reset`` is true ends the session and is no request; so does an event
    time of ``idle_hours`` without a row, where times are known. An ended session
    leaves nothing behind.
    """

    def __init__(self, columns: list[str], choice: tuple[str, ...], order: str | None, reset: str | None, idle_hours: int | None):
        self.columns, self.choice, self.order, self.reset = columns, choice, order, reset
        self.idle = idle_hours and idle_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "choices ARRAY<STRING>, last BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.taken.get() if self.taken.exists() else None
        taken, last = (set(held[0]), held[1]) if held else (set(), None)
        if self.idle and held:
            self.handle.deleteTimer(last + self.idle)
        if self.idle or self.order:
            rows = sorted(rows, key=lambda r: (r["__ms"] if self.idle else 0, r[self.order] if self.order else 0))
        for r in rows:
            if self.idle:
                if last is not None and r["__ms"] - last > self.idle:
                    taken = set()
                last = max(r["__ms"], last or r["__ms"])
            if self.reset and r[self.reset]:
                taken = set()
                continue
            choice = "\x1f".join("\x00" if r[c] is None else str(r[c]) for c in self.choice)
            if choice not in taken:
                taken.add(choice)
                yield Row(*self.columns)(*(r[c] for c in self.columns))
        if taken:
            self.taken.update((sorted(taken), last))
            if self.idle:
                self.handle.registerTimer(last + self.idle)
        elif held:
            self.taken.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.taken.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_of_session(
    requests: DataFrame,
    session: str = "session",
    choice: tuple[str, ...] = ("panel", "conflict"),
    order: str | None = None,
    reset: str | None = None,
    ts: str | None = None,
    idle_hours: int = SESSION_HOURS,
) -> DataFrame:
    """First request of every session and choice, with all columns.

    ``order`` is the column that orders the rows of a micro-batch, ``reset`` the flag
    that ends a session. With an event time ``ts`` a session also ends after
    ``idle_hours`` without a row; rows behind the watermark go.
    """
    stateful(requests.sparkSession)
    processor = FirstOfSession(requests.columns, choice, order, reset, idle_hours if ts else None)
    if not ts:
        return requests.groupBy(session).transformWithState(processor, requests.schema, "Append", "None")
    timed = requests.withWatermark(ts, f"{idle_hours} hours").withColumn("__ms", F.unix_millis(ts))
    return timed.groupBy(session).transformWithState(processor, requests.schema, "Append", "EventTime")


class FirstByPosition(StatefulProcessor):
    """Holds the item with the least position until no repeat has come for some hours."""

    def __init__(self, schema: StructType, hours: int):
        self.schema, self.columns, self.at = schema, schema.names, schema.names.index("pos")
        self.gap = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)
        self.last = handle.getValueState("last", "last BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get() if self.held.exists() else None
        last = self.last.get()[0] if held is not None else None
        if last is not None:
            self.handle.deleteTimer(last + self.gap)
        for ms, r in sorted(((r["__ms"], r) for r in rows), key=lambda x: (x[0], x[1]["pos"])):
            item = tuple(r[c] for c in self.columns)
            if held is not None and ms - last > self.gap:
                yield Row(*self.columns)(*held)
                held = None
            if held is None:
                held, last = item, ms
                continue
            if item[self.at] < held[self.at]:
                held = item
            last = max(last, ms)
        self.held.update(tuple(held))
        self.last.update((last,))
        self.handle.registerTimer(last + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(*self.columns)(*self.held.get())
        self.held.clear()
        self.last.clear()

    def close(self) -> None:
        pass


def first_by_position(items: DataFrame, by: tuple[str, ...], ts: str = "ts", hours: int = ITEM_EXPIRY_HOURS) -> DataFrame:
    """The first item by ``pos`` of each identity within each feed that ``by`` names.

    Repeats that follow each other within ``hours`` are one item, whichever of them
    arrives first; it is released once the event time has passed the last of them by
    ``hours``. An item without identity repeats nothing and passes at once; rows behind
    the watermark go.
    """
    stateful(items.sparkSession)
    keyed = items.withColumn("identity", identity_key(F.col("url"), F.col("title"), F.col("body")))
    blank = F.coalesce(F.col("identity"), F.lit("")) == ""
    known = keyed.filter(~blank).withWatermark(ts, f"{hours} hours")
    output = keyed.drop(ts).schema
    rows = known.withColumn("__ms", F.unix_millis(ts))
    firsts = rows.groupBy(*by, "identity").transformWithState(FirstByPosition(output, hours), output, "Append", "EventTime")
    return firsts.unionByName(keyed.filter(blank).drop(ts))
