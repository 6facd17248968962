"""Streams with keyed state, drained in several micro-batches, against their batch meaning."""

from __future__ import annotations

import random
import tracemalloc
from collections import defaultdict
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import Row

from feedloom.streaming import jobs, state
from tests.test_streams import batches, loop

ONCE = jobs.poll_trigger(once=True)
EVENT = "owner STRING, at STRING, kind STRING, batch BIGINT, pos BIGINT, headline STRING, url STRING"
START = datetime(2024, 1, 1)


def drain(stream, folder):
    out = str(folder / "out")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / "cp")).trigger(**ONCE).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out), query


def notes(spark, folder, groups):
    stream = batches(spark, folder / "in", groups, EVENT)
    alerts, commands = stream.filter("kind = 'alert'"), stream.filter("kind <> 'alert'")
    return drain(state.notifications(alerts, commands), folder)[0]


def alert(owner, at, pos, headline):
    return (owner, f"T{at:04d}", "alert", at, pos, headline, f" https://x/{pos}" if pos % 2 else "ftp://x")


def command(owner, at, kind):
    return (owner, f"T{at:04d}", kind, None, None, None, None)


def test_alerts_by_state(spark, tmp_path):
    """Updates in turn, several in one micro-batch, evicted headlines alert again."""
    rng = random.Random(4)
    updates = [[(i, f" head {rng.randrange(90)} ", "critical") for i in range(rng.randrange(70))] for _ in range(9)]
    rows = [[alert("a", b, i, h) for i, h, _ in u] + [alert("b", b, i, "same") for i in range(3)] for b, u in enumerate(updates)]
    groups = [rows[0] + rows[1], rows[2], sum(rows[3:], [])]
    for g in groups:
        rng.shuffle(g)
    found = notes(spark, tmp_path, groups)
    want_store, want_added = loop(updates)
    added = found.filter("event in ('added', 'announced')")
    assert sorted((r.batch, r.headline) for r in added.filter("owner = 'a'").collect()) == sorted(want_added)
    assert [(r.batch, r.headline) for r in added.filter("owner = 'b'").collect()] == [(0, "same")]
    now = state.current_notifications(found).filter("owner = 'a'").orderBy("place").collect()
    assert [r.headline for r in now] == want_store and all(r.url == (f"https://x/{r.pos}" if r.pos % 2 else None) for r in now)
    shown = added.filter("owner = 'a' and event = 'announced'").groupBy("batch").count().collect()
    assert all(r["count"] == min(3, sum(b == r.batch for b, _ in want_added)) for r in shown)


@pytest.mark.parametrize("seed", [1, 2])
def test_out_of_order_commands_give_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [alert(o, t, rng.randrange(10**6), f"{o} {t}") for o in "abc" for t in rng.sample(range(200), 80)]
    events += [command(o, rng.randrange(200), k) for o in "ab" for k in ("mark_read", "clear", "mark_read")] + [command("d", 5, "clear")]
    alerts = [e for e in events if e[2] == "alert"]
    cut = len(alerts) // 2
    late = [e for e in events if e[2] != "alert"]
    groups = [alerts[:cut] + late[:2], late[2:4] + alerts[cut:], late[4:]]
    got = defaultdict(list)
    for r in state.current_notifications(notes(spark, tmp_path, groups)).orderBy("owner", "place").collect():
        got[r.owner].append((r.at, r.headline, r.is_read))
    want = {}
    for o in "abc":
        last = {k: max((e[1] for e in events if e[0] == o and e[2] == k), default="") for k in ("clear", "mark_read")}
        kept = sorted((e for e in events if e[0] == o and e[2] == "alert" and e[1] > last["clear"]), key=lambda e: e[1], reverse=True)
        want[o] = [(e[1], e[5], e[1] <= last["mark_read"]) for e in kept[:50]]
    assert got == {o: w for o, w in want.items() if w}


def test_clear_lets_a_headline_alert_again(spark, tmp_path):
    groups = [[alert("a", 1, 1, "x"), alert("a", 5, 2, "x"), command("a", 3, "clear")], [command("a", 9, "clear")], [alert("a", 7, 3, "late")]]
    found = notes(spark, tmp_path, groups)
    assert sorted((r.at, r.headline) for r in found.filter("event = 'announced'").collect()) == [("T0001", "x"), ("T0005", "x")]
    assert state.current_notifications(found).count() == 0


REQUEST = "session STRING, panel STRING, conflict STRING, n INT, ended BOOLEAN, ts TIMESTAMP"


def test_session_ends_and_its_state_goes(spark, tmp_path):
    def row(session, panel, n, ended=False, hours=0):
        return (session, panel, None if panel == "x" else "all", n, ended, START + timedelta(hours=hours))

    groups = [
        [row("s1", "news", 2), row("s1", "news", 1), row("s2", "x", 3), row("s1", None, 4, True), row("s1", "news", 5)],
        [row("s1", "news", 6), row("s1", "osint", 7), row("s2", "x", 8), row("s3", "y", 9, None)],
        [row("s1", None, 10, True), row("s2", "x", 11, True)],
        [row("s2", "x", 12), row("s3", "y", 13)],
    ]
    stream = batches(spark, tmp_path / "in", groups, REQUEST)
    passed, query = drain(state.first_of_session(stream, order="n", reset="ended"), tmp_path)
    assert sorted(r.n for r in passed.collect()) == [1, 3, 5, 7, 9, 12]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert held == [2, 3, 1, 2]


def test_idle_session_ends(spark, tmp_path):
    def row(session, n, hours):
        return (session, "news", "all", n, None, START + timedelta(hours=hours))

    groups = [[row("a", 1, 0), row("a", 2, 11), row("b", 3, 5), row("a", 5, 40), row("a", 4, 22)], [row("b", 6, 30), row("c", 7, 90)], [row("c", 8, 91), row("b", 9, 92)]]
    stream = batches(spark, tmp_path / "in", groups, REQUEST)
    passed, query = drain(state.first_of_session(stream, order="n", ts="ts"), tmp_path)
    assert sorted(r.n for r in passed.collect()) == [1, 3, 5, 6, 7, 9]


ITEM = "feed STRING, pos BIGINT, title STRING, url STRING, body STRING, ts TIMESTAMP"


def islands(rows, hours):
    """First by position of repeats that follow each other within ``hours``, and when the last of them was."""
    lives = []
    by = defaultdict(list)
    for r in rows:
        by[r[0], (r[2] or "").strip().lower()].append(r)
    for (_, name), group in by.items():
        group.sort(key=lambda r: r[5])
        life = []
        for r in group:
            if not name or life and r[5] - life[-1][5] > timedelta(hours=hours):
                lives.append(life)
                life = []
            life.append(r)
        lives.append(life)
    return [(min(x, key=lambda r: r[1])[1], x[-1][5]) for x in lives if x]


def test_keep_first_whatever_comes_first(spark, tmp_path):
    """The survivor is the least position, also when its row arrives last."""
    rng = random.Random(3)
    rows = [(rng.choice("fg"), i, rng.choice(["A b", "a B ", "c", "", "d"]), None, None, START + timedelta(hours=i // 4, minutes=rng.randrange(60))) for i in range(160)]
    groups = []
    for k in range(0, 160, 32):
        part = rows[k : k + 32]
        rng.shuffle(part)
        groups.append(part)
    stream = batches(spark, tmp_path / "in", groups, ITEM)
    kept, _ = drain(state.first_by_position(stream, ("feed",), hours=6).select("feed", "pos", "identity"), tmp_path)
    newest = max(r[5] for r in rows)
    want = [pos for pos, last in islands([r for r in rows if r[2].strip()], 6) if last + timedelta(hours=6) <= newest - timedelta(hours=6)]
    want += [r[1] for r in rows if not r[2].strip()]
    assert sorted(r.pos for r in kept.collect()) == sorted(want)


def test_many_alerts_of_one_owner_take_little_memory():
    """A micro-batch of one owner is held as columns, not as a Python row for each alert."""

    class Held:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def put(self, value):
            self.value = value

        update = put

        def clear(self):
            self.value = None

    notes = state.Notifications()
    notes.stored, notes.marks = Held(), Held()
    fields = [c.split()[0] for c in EVENT.split(", ")]
    n = 60_000
    rows = (Row(*fields)("a", f"2024-01-{i * 7919 % n:08d}", "alert", 0, i, f"headline {i}", None) for i in range(n))
    tracemalloc.start()
    held = pa.total_allocated_bytes()
    most = added = 0
    for r in notes.handleInputRows(("a",), rows, None):
        added += r.event in ("announced", "added")
        if added % 5000 == 1:
            most = max(most, pa.total_allocated_bytes() - held)
    most += tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert added == n and [s[0] for s in notes.stored.get()] == [f"2024-01-{n - 1 - i:08d}" for i in range(50)]
    assert most < 300 * n
