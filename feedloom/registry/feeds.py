"""Whole panel feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.json_values import recover
from feedloom.operators import items as it
from feedloom.operators.pages import first_sources
from feedloom.operators.stance import parse_stance
from feedloom.operators.stance import stance_response as stance_runs
from feedloom.plans import feeds as fd
from feedloom.registry.aggregates import GREEDY_SQL, RANK_SQL
from feedloom.registry.core import query
from feedloom.registry.tables import sql_main_text
from feedloom.registry.views import NOW_ISO, TODAY, now, pick, sql_norm_severity, sql_ts
from feedloom.sources.topics import CHANNEL_TAIL_CHARS, CHANNELS, HEAD_CHARS, ITEM_CAPS, LATEST_MESSAGES, SOURCES_PER_TOPIC


@query(
    "timeline",
    f"""with recursive chosen as (select i.conflict, pos, ts_raw, title from (select *, {sql_ts('ts_raw')} ts from items) i join config c using (conflict)
      where ts_raw <> '' and ts between cast(start_date as timestamp) and timestamp '{TODAY} 23:59:59'), {GREEDY_SQL}
    select conflict, pos, ts_raw, md5(title) title from chosen join survivors using (conflict, pos)""",
    ("items", "config"),
)
def timeline(v):
    """Dated items since each topic's start, near-duplicate headlines removed."""
    kept = fd.timeline(v.items(labels=False, urls=False).select("conflict", "pos", "ts_raw", "title"), v.config(), TODAY)
    return kept.select("conflict", "pos", "ts_raw", F.md5("title").alias("title"))


@query(
    "channel_digest",
    f"""select conflict, pos, channel, ts_raw from (select *, row_number() over (partition by conflict order by coalesce(ts_raw, '') desc, pos) rn from messages)
    where rn <= {LATEST_MESSAGES}""",
    ("messages",),
)
def channel_digest(v):
    """The newest of every topic's messages, in one pass."""
    return fd.channel_digest([v.messages()]).select("conflict", "pos", "channel", "ts_raw")


_STORED_SQL = """select conflict, i rank, '@' || conflict channel, 'stored ' || i as text,
      case when i = 1 then {0} else '2024-01-30T20:00:00Z' end ts_raw from config, (select unnest([1, 2]) i)"""


@query(
    "channel_refresh",
    f"""with ranked as (select *, row_number() over (partition by conflict order by pos) rn from page_sources),
    landed as (select s.conflict, s.pos, s.url, right(t, {CHANNEL_TAIL_CHARS}) t from (select * from ranked where rn <= {len(CHANNELS)}) s
      join (select url, {sql_main_text('html')} t from pages) p on p.url = s.url where length(t) > 0),
    due as (select conflict, ord from config where ord % 3 <> 0),
    counted as (select *, row_number() over (partition by conflict order by pos) rn, count(*) over (partition by conflict) n from landed join due using (conflict)),
    corpora as (select conflict, ord, case when rn <= ceil(n / 2) then 0 else 1 end half, md5(string_agg('@' || url || ':' || chr(10) || t, chr(10) || '---' || chr(10) order by pos)) digest
      from counted group by all),
    asked as (select conflict, half, i, digest || ' ' || i as text, case when i % 4 = 0 then null else '2024-01-30T' || lpad((i * 7 % 24)::varchar, 2, '0') || ':00:00Z' end ts_raw
      from corpora, (select unnest(range(0, 15)) i) where not (ord % 7 = 5 and half = 1)),
    newest as (select *, row_number() over (partition by conflict order by coalesce(ts_raw, '') desc, half, i) rank from asked)
    select 'asked' origin, conflict, rank::int as rank, 'c' || i channel, text, ts_raw from newest where rank <= {LATEST_MESSAGES}
    union all select 'stored', conflict, rank, channel, text, ts_raw from ({_STORED_SQL.format("'2024-01-30T23:30:00Z'")}) join config using (conflict) where ord % 3 = 0""",
    ("page_sources", "config"),
)
def channel_refresh(v):
    """Every topic's channel feed: from a fresh snapshot, or asked for again in two halves."""
    config = v.config().select("conflict", "ord")
    newest = F.when(F.col("ord") % 3 == 0, "2024-01-30T23:30:00Z").otherwise("2024-01-30T21:59:59Z")
    message = lambda i, ts: F.struct(
        F.concat(F.lit("@"), "conflict").alias("channel"), F.lit(f"stored {i}").alias("text"), ts.alias("timestamp")
    )
    payload = F.to_json(F.struct(F.array(message(1, newest), message(2, F.lit("2024-01-30T20:00:00Z"))).alias("messages")))
    store = config.filter("ord % 3 <> 2").select(F.concat(F.lit("telegram-feed:"), "conflict").alias("function_name"), payload.alias("response_data"))
    sources = first_sources(v.page_sources().join(config.select("conflict"), "conflict"), len(CHANNELS)).drop("rank")

    def ask(requests):
        i = F.col("i")
        hour = F.lpad((i * 7 % 24).cast("string"), 2, "0")
        ts = F.when(i % 4 != 0, F.concat(F.lit("2024-01-30T"), hour, F.lit(":00:00Z")))
        posts = requests.join(config, "conflict").select("*", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i"))
        post = F.struct("i", F.concat(F.lit("c"), i).alias("channel"), F.concat(F.md5("corpus"), F.lit(" "), i).alias("text"), ts.alias("timestamp"))
        listed = posts.groupBy("conflict", "half", "ord").agg(F.array_sort(F.collect_list(post)).alias("messages"))
        good = F.concat(F.lit("Posts:\n"), F.to_json(F.struct("messages")))
        return listed.select("conflict", "half", F.when((F.col("ord") % 7 == 5) & (F.col("half") == 1), "none").otherwise(good).alias("content"))

    feed = fd.channel_refresh(store, v.table("pages", "url", "html"), sources, ask, now())
    return feed.select("origin", "conflict", F.col("rank").cast("int").alias("rank"), "channel", "text", "ts_raw")


@query(
    "corpus_styles",
    f"""with ranked as (select s.*, row_number() over (partition by s.conflict order by pos) rn from page_sources s),
    texts as (select r.conflict, r.url, rn, {sql_main_text('html')} t from ranked r join pages p on p.url = r.url)
    select 'channel' style, conflict, md5(string_agg('@' || url || ':' || chr(10) || right(t, {CHANNEL_TAIL_CHARS}), chr(10) || '---' || chr(10) order by rn)) digest, count(*) n_sources
    from texts where length(t) > 0 group by 2
    union all select 'topics', conflict, md5(string_agg('=== ' || url || ' ===' || chr(10) || left(t, {HEAD_CHARS['topics']}), chr(10) || chr(10) order by rn)), count(*)
    from texts where length(t) > 0 and rn <= {SOURCES_PER_TOPIC} group by 2""",
    ("page_sources",),
)
def corpus_styles(v):
    """Prompt texts of every topic from all its channels, and from its first pages under their addresses."""
    built = [
        fd.corpus(v.table("pages", "url", "html"), v.page_sources(), style).select(F.lit(style).alias("style"), "conflict", F.md5("corpus").alias("digest"), "n_sources")
        for style in ("channel", "topics")
    ]
    return built[0].unionByName(built[1])


@query(
    "stance_response",
    f"""select doc_id % 97 run, case when count(*) filter (where good) = 0 then 'failed' when count(*) filter (where good) < 12 then 'partial' else 'complete' end status,
      count(*) filter (where good) n_topics, case when count(*) filter (where good) > 0 then '{NOW_ISO}' end last_updated
    from (select doc_id, doc_id % 97 >= 20 and n_chars % 7 + n_chars % 3 > 0 good from documents) group by 1""",
)
def stance_response(v):
    """How each run over several topics went: all, some or none of its records have content."""
    n, run = F.col("n_chars"), F.col("doc_id") % 97
    record = F.struct(
        (n % 7).alias("left_count"), (n % 3).alias("right_count"), F.when(run < 20, "").otherwise(F.col("text")).alias("summary")
    )
    rows = v.table("documents", "doc_id", "text", "n_chars").select(run.alias("run"), F.to_json(record).alias("j"), F.lit(1).alias("wrap"))
    records = parse_stance(recover(v.wrapped(rows), "raw").drop("raw", "stage", "wrap"), "value", NOW_ISO)
    return stance_runs(records, "run", NOW_ISO, topics=12)


@query(
    "osint_feed",
    r"""with r as (select page_id, case page_id % 4 when 0 then null when 3 then null else url end fresh_url, url from pages)
    select 'k' || page_id as k, 'Report ' || page_id title, url, case page_id % 4 when 1 then 'verified' when 2 then 'developing' else 'unverified' end confidence,
      case when page_id % 4 in (1, 2) then 'fresh' else 'stale' end origin
    from r where not (page_id % 8 = 3)
    union all
    select 'k' || page_id, 'Second ' || page_id, url, 'developing', 'fresh' from r where page_id % 4 = 1""",
)
def osint_feed(v):
    """One response per page: recovered items, else the stored item."""
    p = F.col("page_id")
    item = F.struct(
        F.concat(F.lit("Report "), "page_id").alias("title"),
        F.col("url"),
        F.when(p % 4 == 1, "verified").otherwise("Verified").alias("confidence"),
        F.lit(NOW_ISO).alias("timestamp"),
    )
    second = F.struct(
        F.concat(F.lit("Second "), "page_id").alias("title"), F.col("url"), F.lit("x").alias("confidence"), F.lit("").alias("timestamp")
    )
    apology = F.struct(
        F.lit("Unable to retrieve anything").alias("title"), F.col("url"), F.lit("x").alias("confidence"), F.lit("").alias("timestamp")
    )
    no_url = F.struct(
        F.lit("Nameless").alias("title"), F.lit("ftp://x").alias("url"), F.lit("x").alias("confidence"), F.lit("").alias("timestamp")
    )
    pages = v.table("pages", "page_id", "url")
    listed = (
        F.when(p % 4 == 0, F.array(no_url)).when(p % 4 == 1, F.array(item, second, apology)).when(p % 4 == 2, F.array(item, no_url))
    )
    raw = F.when(p % 4 == 3, "nothing found").otherwise(
        F.concat(F.lit("Result: "), F.to_json(F.struct(listed.alias("items"))))
    )
    key = F.concat(F.lit("k"), "page_id").alias("k")
    responses = pages.select(key, raw.alias("raw"))
    stored = pages.select(
        key,
        F.lit(0).cast("bigint").alias("pos"),
        F.when(p % 8 == 3, "No data here").otherwise(F.concat(F.lit("Report "), "page_id")).alias("title"),
        "url",
        F.lit("unverified").alias("confidence"),
        F.lit("2024-01-01").alias("ts_raw"),
    )
    return fd.osint_feed(responses, stored, "k").select("k", "title", "url", "confidence", "origin")


@query(
    "osint_ranked",
    f"""select pos, cast(epoch_ms(coalesce({sql_ts('ts_raw')}, timestamp '1970-01-01')) as bigint) ms from items""",
    ("items",),
)
def osint_ranked(v):
    """Items by parsed time, unreadable times last."""
    ranked = it.osint_order(v.items(labels=False, urls=False).select("pos", "ts_raw"))
    return ranked.select("pos", F.unix_millis("sort_ts").alias("ms"))


@query(
    "analyst_feed",
    r"""with named as (select 'src' || user_id % 20 conflict, event_id response_id, event_id % 3 wrap,
        case event_id % 4 when 0 then 'small ring' when 1 then 'Dr. RED WIDGET, PhD' when 2 then 'widget' else '' end author from events),
    n as (select distinct conflict, author, trim(regexp_replace(regexp_replace(lower(author), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) norm from named),
    h as (select n.conflict, n.author, min(r.ord) ord from n join (select *, lower(name) full_name from roster) r on r.conflict = n.conflict
      and (contains(n.norm, full_name) or contains(full_name, n.norm)) where norm <> '' group by 1, 2)
    select named.conflict, response_id, r.name author, r.title affiliation from named join h using (conflict, author)
    join roster r on r.conflict = h.conflict and r.ord = h.ord""",
    ("roster",),
)
def analyst_feed(v):
    """One response per event: the comment stays if its author is on the roster."""
    e = F.col("event_id")
    comment = F.struct(
        pick(("small ring", "Dr. RED WIDGET, PhD", "widget", ""), e % 4).alias("analyst"),
        F.lit("somebody").alias("affiliation"),
        F.lit("said so").alias("comment"),
        F.lit(NOW_ISO).alias("timestamp"),
    )
    # A few MB of events make many responses to parse: spread while they are two numbers.
    tasks = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = v.table("events", "event_id", "user_id").repartition(tasks, "event_id").select(
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("conflict"),
        e.alias("response_id"),
        (e % 3).alias("wrap"),
        F.to_json(F.struct(F.array(comment).alias("comments"))).alias("j"),
    )
    feed = fd.analyst_feed(v.wrapped(rows), v.roster())
    return feed.select("conflict", "response_id", "author", "affiliation")


@query(
    "stance_report",
    """with d as (select doc_id, source conflict, n_chars % 50 l, n_chars % 30 c, n_chars % 20 r, doc_id % 6 wrap, text from documents)
    select doc_id, conflict, label, left_label, cast(20 as double) total_stories, cast(l as double) left_count, md5(text) summary,
      l / greatest(l + c + 0.0, 0.0001) * 100 left_share, cast(l as bigint) left_shown
    from d join config using (conflict) where wrap not in (3, 5) and l + c + r > 0""",
    ("config",),
)
def stance_report(v):
    """Stance records recovered from one response per document."""
    n = F.col("n_chars")
    record = F.struct(
        (n % 50).alias("left_count"),
        (n % 30).cast("string").alias("center_count"),
        (n % 20).alias("right_count"),
        (n % 50).alias("left_pct"),
        (n % 30).cast("string").alias("center_pct"),
        F.lit("n/a").alias("right_pct"),
        F.col("text").alias("summary"),
    )
    rows = v.table("documents", "doc_id", "source", "text", "n_chars").select(
        "doc_id", F.col("source").alias("conflict"), (F.col("doc_id") % 6).alias("wrap"), F.to_json(record).alias("j")
    )
    report = fd.stance_report(v.wrapped(rows), v.config(), NOW_ISO)
    return report.select(
        "doc_id", "conflict", "label", "left_label", "total_stories", "left_count", F.md5("summary").alias("summary"), "left_share", "left_shown"
    )


@query(
    "news_digest",
    f"""with stories as (
      select response_id, conflict, i pos, json_extract_string(j, '$.stories[' || i || '].headline') headline,
        json_extract_string(j, '$.stories[' || i || '].severity') severity, json_extract_string(j, '$.stories[' || i || '].timestamp') ts_raw
      from (select *, unnest([0, 1]) i from story_json where wrap in (0, 1, 2, 4))),
    ranked as (select *, {sql_norm_severity('severity')} level, row_number() over (partition by conflict order by {RANK_SQL} desc, coalesce(ts_raw, '') desc, response_id, pos) rn from stories)
    select conflict, response_id, cast(pos as bigint) pos, level severity, md5(headline) title from (select *, max(level in ('critical', 'high')) over (partition by conflict) any_urgent from ranked where rn <= {ITEM_CAPS["news"]})
    where level in ('critical', 'high') or not any_urgent""",
    ("story_json",),
)
def news_digest(v):
    """The news panel of every topic from raw responses."""
    digest = fd.news_digest(v.story_responses())
    return digest.select("conflict", "response_id", "pos", "severity", F.md5("title").alias("title"))
