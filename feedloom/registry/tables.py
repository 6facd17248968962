"""Pages, corpora, snapshots and their storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.text import main_text
from feedloom.functions.times import parse_ts
from feedloom.operators import items as it
from feedloom.operators import pages as pg
from feedloom.operators import snapshots as sn
from feedloom.plans.audit import audit
from feedloom.plans.feeds import corpus
from feedloom.registry.core import query
from feedloom.registry.views import NOW, WS_SQL, now, sql_norm_severity, sql_ts
from feedloom.session import scratch_path
from feedloom.sources.buckets import BucketTable
from feedloom.sources.snapshots import SnapshotTable
from feedloom.sources.topics import CHANNEL_TAIL_CHARS, CHANNELS, HEAD_CHARS, ITEM_CAPS, SOURCES_PER_TOPIC, channels

_NOW = f"timestamp '{NOW}'"

_BLOCKS = "|".join(
    ["<!--.*?-->"] + [f"<{t}\\b.*?</{t}>" for t in ("head", "script", "style", "nav", "header", "footer", "aside")]
    + ['<div class="ad">.*?</div>']
)


def sql_main_text(html: str) -> str:
    text = f"regexp_replace(regexp_replace({html}, '(?is){_BLOCKS}', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"regexp_replace(regexp_replace({text}, '{WS_SQL}+', ' ', 'g'), '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


@query(
    "page_text",
    f"select page_id, md5(t) digest, length(t) n_chars from (select page_id, {sql_main_text('html')} t from pages) where length(t) > 0",
)
def page_text(v):
    """Visible text of every landed page, whole."""
    pages = v.table("pages", "page_id", "html").select("page_id", main_text(F.col("html")).alias("t"))
    return pages.filter(F.length("t") > 0).select(
        "page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars")
    )


@query(
    "pages_truncated",
    f"""select page_id, md5(left(t, {HEAD_CHARS['news']})) news, md5(left(t, {HEAD_CHARS['topics']})) topics, md5(right(t, {CHANNEL_TAIL_CHARS})) channel
    from (select page_id, {sql_main_text('html')} t from pages) where length(t) > 0""",
)
def pages_truncated(v):
    """The cut each feed takes of every page."""
    whole = pg.load_pages(v.table("pages", "page_id", "html"), 2**31 - 1)
    return whole.select(
        "page_id",
        F.md5(pg.head(F.col("text"), HEAD_CHARS["news"])).alias("news"),
        F.md5(pg.head(F.col("text"), HEAD_CHARS["topics"])).alias("topics"),
        F.md5(pg.tail(F.col("text"), CHANNEL_TAIL_CHARS)).alias("channel"),
    )


@query(
    "corpus_by_topic",
    f"""select conflict, md5(string_agg('SOURCE: ' || url || chr(10) || left(t, {HEAD_CHARS['news']}), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rn)) digest, count(*) n_sources
    from (select s.conflict, s.url, rn, {sql_main_text('html')} t
      from (select *, row_number() over (partition by conflict order by pos) rn from page_sources) s join pages p on p.url = s.url where rn <= {SOURCES_PER_TOPIC})
    where length(t) > 0 group by 1""",
    ("page_sources",),
)
def corpus_by_topic(v):
    """Prompt text of each topic from its first sources."""
    built = corpus(v.table("pages", "url", "html"), v.page_sources(), "news")
    return built.select("conflict", F.md5("corpus").alias("digest"), "n_sources")


@query(
    "halves",
    """select conflict, pos, rn rank, case when rn <= ceil(n / 2) then 1 else 2 end half from (
      select conflict, pos, row_number() over (partition by conflict order by pos) rn, count(*) over (partition by conflict) n from messages)""",
    ("messages",),
)
def halves(v):
    """Every topic's messages split in two."""
    split = pg.split_halves(v.messages().select("conflict", "pos"))
    return split.select("conflict", "pos", F.col("rank").cast("bigint").alias("rank"), "half")


@query(
    "source_slice",
    f"select conflict, url, rn rank from (select *, row_number() over (partition by conflict order by pos) rn from page_sources) where rn <= {SOURCES_PER_TOPIC}",
    ("page_sources",),
)
def source_slice(v):
    """The first sources of each topic."""
    first = pg.first_sources(v.page_sources(), SOURCES_PER_TOPIC)
    return first.select("conflict", "url", F.col("rank").cast("bigint").alias("rank"))


@query(
    "snapshot_scan",
    """select function_name, md5(response_data) digest, cached_at from store where function_name in ('telegram-feed:all', 'firecrawl-news:iran-us', 'legacy-feed', 'absent')""",
    ("store",),
)
def snapshot_scan(v):
    """Written to a snapshot table, then read back by key."""
    table = SnapshotTable(v.spark, scratch_path(v.spark, "snapshots"))
    table.write(v.store())
    rows = table.read(["telegram-feed:all", "firecrawl-news:iran-us", "legacy-feed", "absent"])
    return rows.select("function_name", F.md5("response_data").alias("digest"), "cached_at")


@query("snapshot_upsert", "select function_name, event_id, md5(response_data) digest from store", ("store",))
def snapshot_upsert(v):
    """Every write of the history applied: the last one per key stays."""
    return v.store().select("function_name", "event_id", F.md5("response_data").alias("digest"))


@query(
    "snapshot_buckets",
    """select function_name, md5(response_data) digest from (select *, row_number() over (partition by function_name
      order by event_id % 2 desc, fetched_at desc, coalesce(cached_at, '') desc, response_data desc) rn from snaps)
    where rn = 1 and function_name not like 'legacy-feed%'""",
    ("snaps",),
)
def snapshot_buckets(v):
    """The history written to a table in buckets by two batches, one of them twice, and keys deleted."""
    table = BucketTable(v.spark, scratch_path(v.spark, "snapshot-buckets"), buckets=16)
    snaps = v.snaps()
    old, new = snaps.filter("event_id % 2 = 0"), snaps.filter("event_id % 2 = 1")
    for batch_id, rows in ((0, old), (1, new), (0, old)):
        table.upsert(rows, "history", batch_id)
    table.delete(table.read().filter(F.col("function_name").startswith("legacy-feed")))
    return table.read().select("function_name", F.md5("response_data").alias("digest"))


@query(
    "snapshot_delete",
    """select event_id, function_name from snaps where function_name not in (select function_name from snaps where cached_at = 'garbage')""",
    ("snaps",),
)
def snapshot_delete(v):
    """History without the keys that ever had an unreadable write time."""
    snaps = v.snaps()
    bad = snaps.filter(F.col("cached_at") == "garbage").select("function_name").distinct()
    return sn.delete_keys(snaps, bad).select("event_id", "function_name")


@query(
    "envelope",
    f"""select conflict, count(*) n_items, cast(sum(pos) as bigint) pos_sum, arg_min(md5(title), rn) first_title, arg_max(md5(title), rn) last_title from (
      select *, row_number() over (partition by conflict order by r desc, coalesce(ts_raw, '') desc, pos) rn
      from (select *, case {sql_norm_severity('severity')} when 'critical' then 5 when 'high' then 4 when 'developing' then 3 when 'verified' then 2 else 1 end r from items))
    where rn <= {ITEM_CAPS["news"]} group by 1""",
    ("items",),
)
def envelope(v):
    """The capped news list of each topic as one JSON payload, parsed back."""
    top = it.top_k_per_topic(v.items(urls=False), ITEM_CAPS["news"])
    sealed = it.emit_envelope(top, "conflict", "stories", ("pos", "title", "severity", "ts_raw"))
    stories = F.try_variant_get(F.try_parse_json("payload"), "$.stories", "array<struct<pos:bigint,title:string>>")
    opened = sealed.withColumn("stories", stories)
    return opened.select(
        "conflict",
        "n_items",
        F.aggregate("stories", F.lit(0).cast("bigint"), lambda a, s: a + s["pos"]).alias("pos_sum"),
        F.md5(F.element_at("stories", 1)["title"]).alias("first_title"),
        F.md5(F.element_at("stories", -1)["title"]).alias("last_title"),
    )


@query(
    "snapshot_items",
    "select event_id, function_name, container, pos, item.headline title, item.timestamp ts_raw from snap_items",
    ("snap_items",),
)
def snapshot_items(v):
    """Item rows of every snapshot payload."""
    rows = sn.explode_snapshots(v.snaps(), keep=("event_id",))
    return rows.select("event_id", "function_name", "container", "pos", "title", "ts_raw")


@query(
    "channel_lookup",
    f"""select channel, label channel_label, count(*) n from (select m.channel, case m.channel {" ".join(f"when '{c}' then '{l}'" for c, l in CHANNELS)} end label from messages m) group by 1, 2""",
    ("messages",),
)
def channel_lookup(v):
    """Messages per channel with its label; unknown channels stay."""
    per_channel = v.messages().groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    return per_channel.join(channels(v.spark), "channel", "left").select("channel", "channel_label", "n")


@query(
    "stale_fallback",
    f"""select function_name, coalesce(f.n, s.n) n, case when f.n is not null then 'fresh' when s.n is not null then 'stale' else 'empty' end origin
    from (select function_name, max(event_id) n from snaps where {sql_ts('cached_at')} >= {_NOW} - interval 12 hours group by 1) f
    full join (select function_name, max(event_id) n from snaps where {sql_ts('cached_at')} < {_NOW} - interval 12 hours group by 1) s using (function_name)""",
    ("snaps",),
)
def stale_fallback(v):
    """Newest write of the last twelve hours per key, else an older one."""
    snaps = v.snaps().withColumn("cached", parse_ts(F.col("cached_at")))
    cutoff = now() - F.expr("INTERVAL 12 HOURS")

    def last(rows):
        return rows.groupBy("function_name").agg(F.max("event_id").alias("payload"))

    merged = sn.stale_fallback(last(snaps.filter(F.col("cached") >= cutoff)), last(snaps.filter(F.col("cached") < cutoff)))
    return merged.select("function_name", F.col("payload").alias("n"), "origin")


@query(
    "candidate_keys",
    """with b as (select distinct split_part(function_name, ':', 1) base from snaps),
    s as (select distinct substr(function_name, instr(function_name, ':') + 1) suffix from snaps where contains(function_name, ':'))
    select base function_name from b union all select base || ':' || suffix from b, s""",
    ("snaps",),
)
def candidate_keys(v):
    """Every base alone and with every suffix seen in the history."""
    snaps = v.snaps()
    bases = snaps.select(sn.base_of(F.col("function_name")).alias("base")).distinct()
    suffixes = snaps.select(sn.suffix_of(F.col("function_name")).alias("suffix")).filter(F.col("suffix").isNotNull())
    return sn.candidate_keys(bases, suffixes)


_AUDIT_SQL = f"""with known as (select * from store where split_part(function_name, ':', 1) in
    ('firecrawl-news','analyst-curated','perplexity-osint','telegram-feed','ai-summarize')
    and (not contains(function_name, ':') or substr(function_name, instr(function_name, ':') + 1) in ('all','iran-us','ukraine-russia','china-taiwan'))),
  rows_ as (select i.*, lower(trim(regexp_replace(i.item.headline, '\\s+', ' ', 'g'))) identity from snap_items i join known k on k.event_id = i.event_id),
  live as (select * from rows_ where coalesce(try_cast(item.timestamp as timestamp) >= {_NOW} - interval 48 hours, true)),
  kept as (select * from live qualify row_number() over (partition by function_name, identity order by pos) = 1),
  verdicts as (select function_name, case when function_name not in (select function_name from known) then 'orphan'
    when not (coalesce({sql_ts('cached_at')} >= {_NOW} - interval 24 hours, false) or cached_at is null and function_name in (select function_name from rows_))
    then 'stale' else 'keep' end verdict from store)"""


@query(
    "audit_report",
    f"""{_AUDIT_SQL}
    select count(distinct r.function_name) audited, (select count(*) from rows_) items_before, (select count(*) from kept) items_after,
      (select count(*) from rows_) - (select count(*) from kept) removed,
      (select count(*) from verdicts where verdict = 'stale') deleted_stale, (select count(*) from verdicts where verdict = 'orphan') deleted_orphaned
    from rows_ r""",
    ("store", "snap_items"),
)
def audit_report(v):
    """What an audit of the current snapshots would change."""
    return audit(v.store(), now())[1]


@query(
    "audit_job",
    f"""{_AUDIT_SQL}
    select v.function_name, coalesce(s.cached_at, strftime({_NOW}, '%Y-%m-%dT%H:%M:%S.%gZ')) cached_at, coalesce(k.n, 0) n_items from verdicts v join store s using (function_name)
    left join (select function_name, count(*) n from kept group by 1) k using (function_name) where verdict = 'keep'""",
    ("store", "snap_items"),
)
def audit_job(v):
    """Snapshots after the audit: who is left, with how many items."""
    after, _ = audit(v.store(), now())
    rows = sn.explode_snapshots(after, keep=("cached_at",), outer=True)
    return rows.groupBy("function_name", "cached_at").agg(F.count("item").alias("n_items"))


@query(
    "audit_payloads",
    f"""{_AUDIT_SQL}
    select v.function_name, md5(string_agg(k.item.headline || '@' || k.item.timestamp, ';' order by k.pos)) digest,
      coalesce(any_value(s.cached_at), strftime({_NOW}, '%Y-%m-%dT%H:%M:%S.%gZ')) stamp
    from verdicts v join store s using (function_name) join kept k using (function_name) where verdict = 'keep' group by 1""",
    ("store", "snap_items"),
)
def audit_payloads(v):
    """What the payloads of cleaned snapshots hold after the audit: their items in order, and the write time."""
    after, _ = audit(v.store(), now())
    stamped = after.withColumn("stamp", F.get_json_object("response_data", "$.cached_at"))
    rows = sn.explode_snapshots(stamped, keep=("stamp",))
    text = F.concat_ws("@", *[F.try_variant_get("item", f"$.{f}", "string") for f in ("headline", "timestamp")])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))), lambda i: i["text"])
    return rows.groupBy("function_name", "stamp").agg(F.md5(F.array_join(listed, ";")).alias("digest")).select("function_name", "digest", "stamp")


@query(
    "evict_feed",
    f"""with newest as (select function_name, max(item.timestamp) newest from snap_items where event_id in (select event_id from store) group by 1),
    fed as (select function_name from store where function_name in ('telegram-feed:all', 'telegram-feed:iran-us', 'telegram-feed:ukraine-russia', 'telegram-feed:china-taiwan')),
    bad as (select count(*) n from fed left join newest using (function_name) where not coalesce(epoch_ms({_NOW}) - epoch_ms(try_cast(newest as timestamp)) <= 7200000, false))
    select function_name from fed where (select n from bad) > 0""",
    ("store", "snap_items"),
)
def evict_feed(v):
    """Channel snapshots to clear, all of them if any has gone stale."""
    store = v.store()
    newest = it.newest_ts(sn.explode_snapshots(store), "function_name")
    return sn.evicted_channel_keys(store, newest, now())
