"""Roll-ups, roster joins, stance, ranking, de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import items as it
from feedloom.operators import near_dupes as nd
from feedloom.operators import stance as st
from feedloom.operators import topics as tp
from feedloom.operators.costs import cost_summary as summarize
from feedloom.operators.costs import cost_totals as totals
from feedloom.operators.costs import price_calls
from feedloom.operators.roster import roster_match as match
from feedloom.operators.snapshots import explode_snapshots
from feedloom.registry.core import query
from feedloom.registry.views import pick, sql_norm_severity, sql_squeeze, sql_words
from feedloom.sources.costs import with_cost_defaults
from feedloom.sources.topics import ALL_LABELS, ITEM_CAPS, LATEST_MESSAGES, prices

RANK_SQL = f"case {sql_norm_severity('severity')} when 'critical' then 5 when 'high' then 4 when 'developing' then 3 when 'verified' then 2 else 1 end"

# Reads each topic in order and keeps what shares fewer than four words with
# everything kept so far.
GREEDY_SQL = f"""w as (
  select conflict, pos, row_number() over (partition by conflict order by coalesce(ts_raw, ''), pos) rn, {sql_words("title")} ws from chosen),
g as (
  select conflict, cast(0 as bigint) rn, cast([] as varchar[][]) kept, cast([] as bigint[]) ids from (select distinct conflict from w)
  union all
  select g.conflict, w.rn,
    case when len(list_filter(g.kept, lambda k: len(list_intersect(k, w.ws)) >= 4)) > 0 then g.kept else list_append(g.kept, w.ws) end,
    case when len(list_filter(g.kept, lambda k: len(list_intersect(k, w.ws)) >= 4)) > 0 then g.ids else list_append(g.ids, w.pos) end
  from g join w on w.conflict = g.conflict and w.rn = g.rn + 1),
survivors as (select conflict, unnest(ids) pos from (select conflict, arg_max(ids, rn) ids from g group by conflict))"""


@query(
    "cost_summary",
    """select panel, provider, count(*) calls, count(*) filter (where cache_hit) cache_hits, count(*) filter (where not cache_hit) cache_misses,
      cast(coalesce(sum(cost_usd), 0) as double) total_cost_usd from cost_log group by 1, 2""",
    ("cost_log",),
)
def cost_summary(v):
    return summarize(v.cost_log())


@query(
    "cost_totals",
    "select count(*) calls, cast(coalesce(sum(cost_usd), 0) as double) total_cost_usd from cost_log",
    ("cost_log",),
)
def cost_totals(v):
    return totals(v.cost_log())


@query(
    "cost_defaults",
    """select event_id, 1 + event_id % 3 units, case when event_id % 4 = 0 then 'page' else 'request' end unit_type,
      coalesce(event_id % 5 = 0, false) cache_hit, cast(case when event_id % 5 = 0 then 0 else cast(value as decimal(18,6)) end as double) cost_usd
    from events""",
)
def cost_defaults(v):
    """Log rows with everything a caller left out filled in."""
    e = F.col("event_id")
    rows = v.table("events", "event_id", "event_type", "value", "ts").select(
        "event_id",
        F.col("event_type").alias("panel"),
        F.lit("scraper").alias("provider"),
        F.when(e % 3 > 0, (e % 3 + 1).cast("decimal(18,6)")).alias("units"),
        F.when(e % 4 == 0, "page").alias("unit_type"),
        F.col("value").cast("decimal(18,6)").alias("cost_usd"),
        F.when(e % 5 == 0, True).alias("cache_hit"),
        F.col("ts").alias("created_at"),
    )
    return with_cost_defaults(rows).select(
        "event_id", F.col("units").cast("bigint").alias("units"), "unit_type", "cache_hit", F.col("cost_usd").cast("double").alias("cost_usd")
    )


@query(
    "priced_calls",
    """with models as (select * from (values (0, 'firecrawl', 'scrape', 0.0015), (1, 'perplexity', 'sonar', 0.005),
        (2, 'perplexity', 'sonar-pro', 0.015), (3, 'google_ai', 'gemini-flash', 0.0008), (4, 'other', 'none', null),
        (5, 'firecrawl', 'scrape-v1', 0.0015), (6, 'google_ai', 'google/gemini-2.5-flash', 0.0008)) m(e, provider, model, price))
    select provider, model, count(*) calls, cast(sum((1 + user_id % 4) * cast(price as decimal(18,6))) as double) cost_usd
    from events join models on event_id % 7 = e group by 1, 2""",
)
def priced_calls(v):
    """Cost per provider and model, from the price list; null where a model has no price."""
    e = F.col("event_id") % 7
    providers = ("firecrawl", "perplexity", "perplexity", "google_ai", "other", "firecrawl", "google_ai")
    models = ("scrape", "sonar", "sonar-pro", "gemini-flash", "none", "scrape-v1", "google/gemini-2.5-flash")
    calls = v.table("events", "event_id", "user_id").select(
        pick(providers, e).alias("provider"),
        pick(models, e).alias("model"),
        (F.lit(1) + F.col("user_id") % 4).cast("decimal(18,6)").alias("units"),
    )
    priced = price_calls(calls, prices(v.spark))
    return priced.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").cast("double").alias("cost_usd")
    )


@query(
    "newest_ts",
    "select function_name, max(nullif(item.timestamp, '')) newest from snap_items group by 1",
    ("snap_items",),
)
def newest_ts(v):
    return it.newest_ts(explode_snapshots(v.snaps()), "function_name")


@query(
    "all_config",
    f"""select 'all' conflict, {", ".join(f"'{val}' as {key}" for key, val in ALL_LABELS.items())},
      string_agg(search_terms, '; ' order by ord) search_terms, min(start_date) start_date, count(*) n_topics from config""",
    ("config",),
)
def all_config(v):
    """The topic that stands for all of them."""
    return tp.derive_all_config(v.config())


@query(
    "all_sources",
    r"""select 'all' conflict, url, cast(first.o as bigint) first_ord, first.p first_pos from (
      select host url, min({'o': ord, 'p': pos}) first from (
        select regexp_extract(url, '^https?://([^/:?#]+)', 1) host, pos, conflict from page_sources) join config using (conflict) group by 1)""",
    ("page_sources", "config"),
)
def all_sources(v):
    """Distinct source hosts over all topics with their first position."""
    hosts = v.page_sources().withColumn("url", F.try_parse_url("url", F.lit("HOST")))
    merged = tp.derive_all_sources(hosts, v.config())
    return merged.withColumn("first_ord", F.col("first_ord").cast("bigint"))


@query(
    "all_roster",
    "select 'all' conflict, kind, count(*) n, min(ord) first_ord, max(ord) last_ord from roster group by kind",
    ("roster",),
)
def all_roster(v):
    """Everyone on any roster, in one list."""
    return tp.derive_all_roster(v.roster()).groupBy("conflict", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
    )


@query(
    "roster_text",
    """select conflict, kind, case kind when 'official' then 'OFFICIALS' else 'EXPERT ANALYSTS' end || ':' || chr(10)
      || string_agg('- ' || name || ' (' || title || ')', chr(10) order by ord) section
    from (select conflict, kind, name, min(ord) ord, arg_min(title, ord) title from roster group by 1, 2, 3) group by 1, 2""",
    ("roster",),
)
def roster_text(v):
    """Roster section per topic and kind, each name once."""
    people = (
        v.roster()
        .groupBy("conflict", "kind", "name")
        .agg(F.min(F.struct("ord", "title")).alias("first"))
        .select("conflict", "kind", "name", "first.ord", "first.title")
    )
    return tp.roster_section(people)


@query(
    "roster_match",
    r"""with names as (select conflict, author, trim(regexp_replace(regexp_replace(lower(author), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) norm
      from (select distinct conflict, author from comments)),
    people as (select conflict, trim(regexp_replace(regexp_replace(lower(name), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) full_name, min(ord) ord from roster group by 1, 2),
    hits as (select n.conflict, n.author, min(p.ord) ord from names n join people p on p.conflict = n.conflict
      and (contains(n.norm, p.full_name) or contains(p.full_name, n.norm)) where n.norm <> '' group by 1, 2)
    select c.conflict, r.name author, r.title affiliation, count(*) n, sum(c.quantity) quantity
    from comments c join hits h using (conflict, author) join roster r on r.conflict = h.conflict and r.ord = h.ord group by 1, 2, 3""",
    ("comments", "roster"),
)
def roster_match(v):
    """Comments per resolved roster member."""
    kept = match(v.comments(), v.roster())
    return kept.groupBy("conflict", "author", "affiliation").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")
    )


@query(
    "config_join",
    "select conflict, label, left_label, right_label, start_date, count(*) n from items join config using (conflict) group by 1, 2, 3, 4, 5",
    ("items", "config"),
)
def config_join(v):
    """Items per topic with the topic's labels."""
    per_topic = v.items(labels=False, urls=False).groupBy("conflict").agg(F.count(F.lit(1)).alias("n"))
    return per_topic.join(v.config(), "conflict").select(
        "conflict", "label", "left_label", "right_label", "start_date", "n"
    )


@query(
    "title_pairs",
    f"""with recursive chosen as (select conflict, pos, ts_raw, title from items), {GREEDY_SQL},
    k as (select w.* from w join survivors using (conflict, pos))
    select conflict, pos, kept_pos, shared from (
      select d.conflict, d.pos, k.pos kept_pos, cast(len(list_intersect(d.ws, k.ws)) as bigint) shared,
        row_number() over (partition by d.conflict, d.pos order by k.rn) first
      from w d join k on k.conflict = d.conflict and k.rn < d.rn and len(list_intersect(d.ws, k.ws)) >= 4
      where not exists (select 1 from survivors s where s.conflict = d.conflict and s.pos = d.pos)) where first = 1""",
    ("items",),
)
def title_pairs(v):
    """Each dropped headline with the first kept headline it repeats."""
    pairs = nd.title_pairs(v.items(labels=False, urls=False))
    return pairs.withColumn("shared", F.col("shared").cast("bigint"))


@query(
    "timeline_dedupe",
    f"with recursive chosen as (select conflict, pos, ts_raw, title from items), {GREEDY_SQL} select conflict, pos from survivors",
    ("items",),
)
def timeline_dedupe(v):
    """Items that survive greedy headline de-duplication."""
    return nd.dedupe_titles(v.items(labels=False, urls=False)).select("conflict", "pos")


_STANCE_SQL = """select conflict, count(*) total_stories,
  count(*) filter (where stance = 'left') left_count, count(*) filter (where stance = 'center') center_count, count(*) filter (where stance = 'right') right_count,
  {picks} from (select *, n_chars % 100 strength from items where stance is not null) group by 1"""
_PICKS = ", ".join(
    f"arg_max(title, {{'s': strength, 'p': -pos}}) filter (where stance = '{s}') top_{s}_story" for s in ("left", "center", "right")
)


def _stories(v):
    return v.items(urls=False).withColumn("strength", F.col("n_chars") % 100)


@query(
    "stance_summary",
    f"""select *, left_count * 100 / total_stories left_pct, center_count * 100 / total_stories center_pct, right_count * 100 / total_stories right_pct
    from ({_STANCE_SQL.format(picks=_PICKS)})""",
    ("items",),
)
def stance_summary(v):
    """Counts, shares and one headline per stance for every topic."""
    return st.stance_summary(_stories(v))


@query(
    "spectrum",
    """select event_id, l / t * 100 left_share, c / t * 100 center_share, r / t * 100 right_share,
      cast(floor(l + 0.5) as bigint) left_shown, cast(floor(c + 0.5) as bigint) center_shown, cast(floor(r + 0.5) as bigint) right_shown
    from (select *, greatest(l + c + r, 0.0001) t from (
      select event_id, case when event_id % 9 = 0 then 0.0 else cast(event_id % 101 as double) + 0.5 end l,
        case when event_id % 9 = 0 then 0.0 else cast(user_id % 61 as double) end c,
        case when event_id % 9 = 0 then 0.0 else cast(user_id % 7 as double) * 12.5 end r from events))""",
)
def spectrum(v):
    """Bar shares and displayed percentages."""
    e, u = F.col("event_id"), F.col("user_id")
    zero = e % 9 == 0
    rows = v.table("events", "event_id", "user_id").select(
        "event_id",
        F.when(zero, 0.0).otherwise((e % 101).cast("double") + 0.5).alias("left_pct"),
        F.when(zero, 0.0).otherwise((u % 61).cast("double")).alias("center_pct"),
        F.when(zero, 0.0).otherwise((u % 7).cast("double") * 12.5).alias("right_pct"),
    )
    return st.spectrum(rows).drop("left_pct", "center_pct", "right_pct")


@query(
    "stance_all",
    f"""select conflict, label, left_label, center_label, right_label, total_stories, left_count, center_count, right_count
    from ({_STANCE_SQL.format(picks="1 as one")}) join config using (conflict)""",
    ("items", "config"),
)
def stance_all(v):
    """One stance row per topic with its labels."""
    labels = v.config().select("conflict", "label", "left_label", "center_label", "right_label")
    return st.stance_summary(_stories(v)).join(labels, "conflict").select(
        "conflict", "label", "left_label", "center_label", "right_label",
        "total_stories", "left_count", "center_count", "right_count",
    )


@query(
    "dedupe_identity",
    f"""select conflict, pos, md5(identity) identity from (select *, row_number() over (partition by conflict, identity order by pos) rn from (
      select conflict, pos, {sql_squeeze("coalesce(url, title, body, '')")} identity from items)) where rn = 1 or identity = ''""",
    ("items",),
)
def dedupe_identity(v):
    """First item of each identity; blank identities all stay."""
    kept = it.dedupe_identity(v.items(labels=False), "conflict")
    return kept.select("conflict", "pos", F.md5("identity").alias("identity"))


@query(
    "latest_messages",
    f"""select conflict, pos, channel, ts_raw, rn rank from (select *, row_number() over (partition by conflict order by coalesce(ts_raw, '') desc, pos) rn from messages)
    where rn <= {LATEST_MESSAGES}""",
    ("messages",),
)
def latest_messages(v):
    kept = it.latest_messages(v.messages(), LATEST_MESSAGES)
    return kept.select("conflict", "pos", "channel", "ts_raw", F.col("rank").cast("bigint").alias("rank"))


@query(
    "timeline_desc",
    "select conflict, pos, ts_raw, row_number() over (partition by conflict order by coalesce(ts_raw, '') desc, pos) = 1 newest from items",
    ("items",),
)
def timeline_desc(v):
    """Display order, newest raw timestamp first; the newest of a topic is marked."""
    items = v.items(labels=False, urls=False).select("conflict", "pos", F.coalesce("ts_raw", F.lit("")).alias("sort_ts"), "ts_raw")
    top = items.groupBy("conflict").agg(F.max(F.struct("sort_ts", (-F.col("pos")).alias("neg"))).alias("top"))
    marked = items.join(top.select("conflict", (-F.col("top.neg")).alias("first")), "conflict")
    return marked.select("conflict", "pos", "ts_raw", (F.col("pos") == F.col("first")).alias("newest")).orderBy(
        "conflict", F.coalesce("ts_raw", F.lit("")).desc(), "pos"
    )


@query(
    "topk_news",
    f"""select conflict, pos, level, rn rank from (select *, row_number() over (partition by conflict order by r desc, coalesce(ts_raw, '') desc, pos) rn
      from (select *, {RANK_SQL} r, {sql_norm_severity('severity')} level from items)) where rn <= {ITEM_CAPS["news"]}""",
    ("items",),
)
def topk_news(v):
    """The most important items of each topic."""
    kept = it.top_k_per_topic(v.items(urls=False), ITEM_CAPS["news"])
    return kept.select(
        "conflict", "pos", it.norm_severity(F.col("severity")).alias("level"), F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "union_feeds",
    """select feed, conflict, count(*) n, count(ts_raw) dated from (
      select 'topics' feed, conflict, ts_raw from items union all select 'channel', conflict, ts_raw from messages) group by 1, 2""",
    ("items", "messages"),
)
def union_feeds(v):
    """All feeds in one table, counted per feed and topic."""
    topics = v.items(labels=False, urls=False).select(F.lit("topics").alias("feed"), "conflict", "ts_raw")
    posts = v.messages().select(F.lit("channel").alias("feed"), "conflict", "ts_raw")
    return topics.unionByName(posts).groupBy("feed", "conflict").agg(
        F.count(F.lit(1)).alias("n"), F.count("ts_raw").alias("dated")
    )
