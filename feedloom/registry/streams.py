"""Alerts, sessions and the streaming jobs, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import alerts as al
from feedloom.operators.items import critical_only
from feedloom.registry.core import query
from feedloom.registry.views import sql_iso, sql_squeeze, sql_trim
from feedloom.session import scratch_path
from feedloom.sources.topics import ANNOUNCED_ALERTS, STORED_ALERTS
from feedloom.streaming import jobs, state


@query(
    "notif_load",
    f"select batch, pos, headline from notifications where {sql_trim('headline')} <> '' order by batch desc, pos limit {STORED_ALERTS}",
    ("notifications",),
)
def notif_load(v):
    """The stored notifications a session starts with."""
    return al.load_notifications(v.notifications()).select("batch", "pos", "headline")


@query(
    "notif_cap",
    f"select batch, pos, headline from (select * from notifications order by batch desc, pos limit {STORED_ALERTS})",
    ("notifications",),
)
def notif_cap(v):
    """New notifications first, cut at the store's size."""
    rows = v.notifications()
    newest = rows.agg(F.max("batch")).scalar()
    added, old = rows.filter(F.col("batch") == newest), rows.filter(F.col("batch") < newest)
    return al.cap_store(added, old).select("batch", "pos", "headline")


@query("unread", "select count(*) filter (where not is_read) unread from notifications", ("notifications",))
def unread(v):
    return al.unread_count(v.notifications())


_COMMANDS_SQL = f"""commands as (select case event_type when 'signup' then 'mark_read' else 'clear' end command, {sql_iso('ts')} as at_ from events
  where event_type = 'signup' and user_id % 50 = 7 or event_type = 'purchase' and user_id % 75 = 11 and event_id % 5 = 0)"""


@query(
    "notif_state",
    f"""with {_COMMANDS_SQL}
    select pos, added_at, is_read or coalesce(added_at <= (select max(at_) from commands where command = 'mark_read'), false) is_read
    from notifications where coalesce(added_at > (select max(at_) from commands where command = 'clear'), true)""",
    ("notifications",),
)
def notif_state(v):
    """Notifications after all mark-read and clear commands."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    marks = (kind == "signup") & (u % 50 == 7)
    clears = (kind == "purchase") & (u % 75 == 11) & (e % 5 == 0)
    commands = v.table("events", "event_id", "user_id", "event_type", "ts").filter(marks | clears).select(
        F.when(kind == "signup", "mark_read").otherwise("clear").alias("command"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
    )
    return al.apply_commands(v.notifications(), commands).select("pos", "added_at", "is_read")


@query(
    "new_alerts",
    """with seen as (select distinct headline from alerts where batch = 0)
    select headline, min(pos) pos from alerts where batch > 0 and headline not in (select headline from seen) and batch is not null group by 1
    union all select 'fresh ' || user_id, min(event_id) from events group by 1""",
    ("alerts",),
)
def new_alerts(v):
    """Headlines of later weeks not seen in the first, each once."""
    alerts = v.alerts()
    extra = v.table("events", "event_id", "user_id").select(
        F.col("event_id").alias("pos"), F.concat(F.lit(" fresh "), "user_id", F.lit("\t")).alias("headline")
    )
    batch = alerts.filter(F.col("batch") > 0).select("pos", "headline").unionByName(extra)
    store = alerts.filter(F.col("batch") == 0).select("headline").distinct()
    return al.anti_seen(batch, store).select("headline", "pos")


@query(
    "alert_cap",
    f"""select batch, headline, pos from (select batch, headline, min(pos) pos from alerts group by 1, 2)
    qualify row_number() over (partition by batch order by pos) <= {ANNOUNCED_ALERTS}""",
    ("alerts",),
)
def alert_cap(v):
    """The first few new alerts of each update."""
    firsts = v.alerts().groupBy("batch", "headline").agg(F.min("pos").alias("pos"))
    return al.announce(firsts, group="batch").select("batch", "headline", "pos")


@query(
    "alert_replay",
    f"""with recursive b as (select batch, list(headline order by pos) hs from (select batch, headline, min(pos) pos from alerts group by 1, 2) group by 1),
    r as (select cast(-1 as bigint) n, cast([] as varchar[]) store, cast([] as varchar[]) added
      union all select b.batch, list_slice(list_concat(list_filter(b.hs, lambda h: not list_contains(r.store, h)), r.store), 1, {STORED_ALERTS}),
        list_filter(b.hs, lambda h: not list_contains(r.store, h)) from r join b on b.batch = r.n + 1)
    select n batch, unnest(added) headline from r""",
    ("alerts",),
)
def alert_replay(v):
    """All updates in turn against the stored notifications, in one pass over a stream of events.

    An alert pushed out of the store may be announced again.
    """
    alerts = critical_only(v.alert_items(_replayed(v, "events"))).select(
        F.lit("all").alias("owner"), F.lpad(F.col("batch").cast("string"), 9, "0").alias("at"), "batch", "pos", "headline", "url"
    )
    notes = _drained(v, state.notifications(alerts), "alerts")
    return notes.filter("event in ('announced', 'added')").select("batch", "headline")


_NOTE_SQL = f"""select user_id % 40 owner, event_id pos, {sql_iso('ts')} as at_, event_type from events"""


@query(
    "notif_commands",
    f"""with notes as ({_NOTE_SQL}),
    last as (select owner, max(at_) filter (where event_type = 'signup' and pos % 9 = 0) marked, max(at_) filter (where event_type = 'purchase' and pos % 50 = 3) cleared
      from notes group by 1),
    kept as (select owner, pos, at_, coalesce(at_ <= marked, false) is_read, row_number() over (partition by owner order by at_ desc, pos) - 1 place
      from notes join last using (owner) where event_type not in ('signup', 'purchase') and coalesce(at_ > cleared, true))
    select owner::varchar as owner, place::int as place, pos, is_read from kept where place < {STORED_ALERTS}""",
)
def notif_commands(v):
    """Every user group's notifications after a stream of alerts and commands."""
    e, kind = F.col("pos"), F.col("event_type")
    rows = _replayed(v, "events").select(
        (F.col("user_id") % 40).cast("string").alias("owner"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        F.lit(0).cast("bigint").alias("batch"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("note "), "event_id").alias("headline"),
        F.lit(None).cast("string").alias("url"),
        "event_type",
    )
    marks, clears = (kind == "signup") & (e % 9 == 0), (kind == "purchase") & (e % 50 == 3)
    commands = rows.filter(marks | clears).withColumn("kind", F.when(marks, state.MARK_READ).otherwise(state.CLEAR))
    alerts = rows.filter(~kind.isin("signup", "purchase"))
    notes = _drained(v, state.notifications(alerts, commands), "notes")
    return state.current_notifications(notes).select("owner", "place", "pos", "is_read")


def _requests(v):
    return _replayed(v, "events").select(
        F.col("user_id").alias("session"), F.col("event_type").alias("panel"), (F.col("user_id") % 4).alias("conflict"), "event_id"
    )


@query(
    "force_once",
    "select user_id session_id, event_type panel, user_id % 4 topic, min(event_id) event_id from events group by 1, 2, 3",
)
def force_once(v):
    """First request per session, panel and topic, over a stream of requests."""
    first = _drained(v, jobs.force_once(_requests(v), order="event_id"), "forced")
    return first.select(F.col("session").alias("session_id"), "panel", F.col("conflict").alias("topic"), "event_id")


@query(
    "force_sessions",
    """with numbered as (select *, user_id % 300 session, count(*) filter (where event_type = 'signup' and event_id % 4 = 0) over (partition by user_id % 300 order by event_id) life from events)
    select session, event_type panel, life, min(event_id) event_id from numbered where not (event_type = 'signup' and event_id % 4 = 0) group by 1, 2, 3""",
)
def force_sessions(v):
    """As ``force_once``, for sessions that a reset event ends."""
    rows = _requests(v).select((F.col("session") % 300).alias("session"), "panel", "event_id")
    rows = rows.withColumn("ended", (F.col("panel") == "signup") & (F.col("event_id") % 4 == 0))
    first = _drained(v, jobs.force_once(rows, choice=("panel",), order="event_id", reset="ended"), "sessions")
    ends = v.table("events", "event_id", "user_id", "event_type").filter((F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0))
    ends = ends.select((F.col("user_id") % 300).alias("own"), F.col("event_id").alias("end"))
    # Which life of its session a request belongs to: the resets before it.
    lives = first.join(ends, (F.col("session") == F.col("own")) & (F.col("end") <= F.col("event_id")), "left")
    return lives.groupBy("session", "panel", "event_id").agg(F.count("end").alias("life")).select("session", "panel", "life", "event_id")


@query(
    "stream_first",
    f"""with items as (
      select lang, doc_id pos, {sql_squeeze("split_part(text, chr(10), 1)")} identity, 1704067200 + (doc_id * 7919) % 2592000 s from documents
    ), known as (select *, case when s - lag(s) over (partition by lang, identity order by s, pos) > 172800 then 1 else 0 end begins from items where identity <> ''),
    lives as (select *, sum(begins) over (partition by lang, identity order by s, pos rows unbounded preceding) life from known),
    firsts as (select lang, identity, min(pos) pos, max(s) last, life < max(life) over (partition by lang, identity) followed from lives group by lang, identity, life)
    select lang, pos, md5(identity) identity from firsts where followed or last + 172800 <= (select max(s) - 172800 from known)
    union all select lang, pos, md5(identity) from items where identity = ''""",
)
def stream_first(v):
    """The first item of each identity in each language's feed, once no repeat can come any more."""
    items = _replayed(v, "documents").select(
        "lang",
        F.col("doc_id").alias("pos"),
        F.lit(None).cast("string").alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.lit(None).cast("string").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 7919) % 2592000).alias("ts"),
    )
    kept = state.first_by_position(items, ("lang",)).select("lang", "pos", F.md5("identity").alias("identity"))
    return _drained(v, kept, "firsts")


def _replayed(v, name: str):
    """A table as a stream, drained once; the pattern fits a table of one file or a folder of files."""
    schema = v.table(name).schema
    return v.spark.readStream.schema(schema).parquet(f"{v.base.rstrip('/')}/{name}.parque[t]")


def _drained(v, stream, name: str):
    """What a stream writes until its source is read."""
    path = scratch_path(v.spark, name)
    (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", scratch_path(v.spark, f"{name}-stream"))
        .trigger(**jobs.poll_trigger(once=True))
        .start()
        .awaitTermination()
    )
    return v.spark.read.schema(stream.schema).parquet(path)


@query(
    "cost_stream",
    """select event_type panel, count(*) n, sum(case when user_id % 3 = 0 then 1 else 0 end) hits,
      cast(sum(case when user_id % 3 = 0 then 0 else cast(value as decimal(18,6)) end) as double) cost_usd from events group by 1""",
)
def cost_stream(v):
    """Events streamed into the cost log, then summed up."""
    rows = _replayed(v, "events").select(
        F.col("event_type").alias("panel"),
        F.lit("scraper").alias("provider"),
        F.col("value").cast("decimal(18,6)").alias("cost_usd"),
        (F.col("user_id") % 3 == 0).alias("cache_hit"),
        F.col("ts").alias("created_at"),
    )
    path = scratch_path(v.spark, "cost-log")
    jobs.cost_sink(rows, path, scratch_path(v.spark, "cost-stream"), **jobs.poll_trigger(once=True)).awaitTermination()
    log = v.spark.read.parquet(path)
    return log.groupBy("panel").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cache_hit").alias("hits"), F.sum("cost_usd").cast("double").alias("cost_usd")
    )


@query(
    "stream_cleanup",
    f"""with items as (
      select lang, case when doc_id % 10 = 0 then '' else {sql_squeeze("split_part(text, chr(10), 1)")} end identity
      from documents
    )
    select lang, md5(identity) identity, count(*) n from items where identity = '' group by all
    union all
    select distinct lang, md5(identity), 1 from items where identity <> ''""",
)
def stream_cleanup(v):
    """Items left of each language's feed after streaming every document through the clean-up.

    Which of two repeats survives inside a batch is open, so identities are
    counted. Every tenth item has an empty url, hence no identity, and stays.
    """
    i = F.col("doc_id")
    items = _replayed(v, "documents").select(
        "lang",
        F.when(i % 10 == 0, F.lit("")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + (i * 7919) % 2592000).alias("ts"),
    )
    kept = jobs.late_item_cleanup(items, by=("lang",)).select("lang", F.md5("identity").alias("identity"))
    return _drained(v, kept, "clean-items").groupBy("lang", "identity").agg(F.count("*").alias("n"))
