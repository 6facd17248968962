"""Predicates and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions.text import http_url_or_null, is_http_url, is_translatable
from feedloom.functions.times import age_hours, parse_ts
from feedloom.operators import items as it
from feedloom.operators import snapshots as sn
from feedloom.operators import translate as tr
from feedloom.operators.stance import has_content
from feedloom.operators.topics import relevance
from feedloom.registry.core import query
from feedloom.registry.views import (
    KNOWN_CHANNELS,
    NOW,
    SNAP_CONTAINER_SQL,
    TODAY,
    now,
    sql_in,
    sql_is_url,
    sql_norm_severity,
    sql_trim,
    sql_ts,
)
from feedloom.sources.topics import ITEM_EXPIRY_HOURS, PROTECTED_KEYS, RECENCY_DAYS

_NOW = f"timestamp '{NOW}'"


@query(
    "conflict_norm",
    """select c conflict, count(*) n from (select case when s in ('all','iran-us','ukraine-russia','china-taiwan') then s else 'all' end c from (
      select case user_id % 5 when 0 then 'iran-us' when 1 then 'Iran-US' when 2 then 'china-taiwan' when 3 then null else event_type end s from events))
    group by 1""",
)
def conflict_norm(v):
    """Requests per topic; unknown or differently cased names mean all."""
    u = F.col("user_id") % 5
    raw = (
        F.when(u == 0, "iran-us").when(u == 1, "Iran-US").when(u == 2, "china-taiwan").when(u == 3, F.lit(None))
        .otherwise(F.col("event_type"))
    )
    return (
        v.table("events", "user_id", "event_type")
        .groupBy(it.normalize_conflict(raw).alias("conflict"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "valid_urls",
    f"select pos, {sql_is_url('url')} valid, case when {sql_is_url('url')} then {sql_trim('url')} end clean from items",
    ("items",),
)
def valid_urls(v):
    url = F.col("url")
    return v.items(labels=False).select("pos", is_http_url(url).alias("valid"), http_url_or_null(url).alias("clean"))


@query("osint_valid", f"select conflict, pos, title from items where {sql_is_url('url')}", ("items",))
def osint_valid(v):
    return it.require_url(v.items(labels=False)).select("conflict", "pos", "title")


@query(
    "timeline_range",
    f"""select conflict, pos, ts_raw from (select i.*, {sql_ts('ts_raw')} ts, c.start_date from items i join config c using (conflict))
    where ts_raw <> '' and ts between cast(start_date as timestamp) and timestamp '{TODAY} 23:59:59'""",
    ("items", "config"),
)
def timeline_range(v):
    """Items dated between their topic's start and the end of today."""
    return it.in_date_range(v.items(labels=False, urls=False), v.config(), TODAY).select("conflict", "pos", "ts_raw")


@query(
    "cache_fresh",
    f"""select event_id, coalesce(epoch_ms({_NOW}) - epoch_ms({sql_ts('cached_at')}) < 3600000, false) fresh from snaps""",
    ("snaps",),
)
def cache_fresh(v):
    fresh = sn.is_fresh(F.col("cached_at"), F.lit(3_600_000), now())
    return v.snaps().select("event_id", fresh.alias("fresh"))


@query(
    "cache_ttl",
    f"""select event_id, max_age_ms, coalesce(epoch_ms({_NOW}) - epoch_ms({sql_ts('cached_at')}) < max_age_ms, false) hit from (
      select *, cast(case when event_id % 7 = 0 then 300000 when event_id % 3 = 0 then 43200000 else 3600000 end as bigint) max_age_ms from snaps)""",
    ("snaps",),
)
def cache_ttl(v):
    """Age limit per request (panel, forced or not) and whether it is met."""
    base = F.when(F.col("event_id") % 3 == 0, "bias-tracker").otherwise(sn.base_of(F.col("function_name")))
    limit = sn.effective_max_age(base, F.col("event_id") % 7 == 0).cast("bigint")
    return v.snaps().withColumn("max_age_ms", limit).select(
        "event_id", "max_age_ms", sn.is_fresh(F.col("cached_at"), F.col("max_age_ms"), now()).alias("hit")
    )


@query(
    "feed_newest_fresh",
    f"""select function_name, newest, coalesce(epoch_ms({_NOW}) - epoch_ms(try_cast(newest as timestamp)) <= 7200000, false) fresh,
      round((epoch_ms({_NOW}) - epoch_ms(try_cast(newest as timestamp))) / 3600000.0, 2) age_hours
    from (select function_name, max(item.timestamp) newest from snap_items group by 1)""",
    ("snap_items",),
)
def feed_newest_fresh(v):
    """Newest item of every snapshot key and whether it is recent enough."""
    newest = it.newest_ts(sn.explode_snapshots(v.snaps()), "function_name")
    return newest.select(
        "function_name",
        "newest",
        sn.newest_is_fresh(F.col("newest"), now()).alias("fresh"),
        age_hours(parse_ts(F.col("newest")), now()).alias("age_hours"),
    )


@query(
    "cache_nonempty",
    f"""select event_id, coalesce(json_array_length(case container when 'array' then cast(response_data as json) else json_extract(response_data, '$.' || container) end), 0) > 0 hit
    from (select *, {SNAP_CONTAINER_SQL} container from snaps)""",
    ("snaps",),
)
def cache_nonempty(v):
    """A snapshot with an empty item list is no hit."""
    parsed = v.snaps().withColumn("payload", F.try_parse_json("response_data"))
    items = sn.items_of(F.col("payload"), sn.container_of(F.col("payload"))).cast("array<variant>")
    return parsed.select("event_id", F.coalesce(F.size(items) > 0, F.lit(False)).alias("hit"))


@query(
    "store_policy",
    f"""select event_id from (select *, split_part(function_name, ':', 1) base, coalesce(json_array_length(
        case container when 'array' then cast(response_data as json) else json_extract(response_data, '$.' || container) end), 0) n
      from (select *, {SNAP_CONTAINER_SQL} container from snaps)) where n > 0 or base <> 'perplexity-osint'""",
    ("snaps",),
)
def store_policy(v):
    """Refreshes worth storing: some feeds keep an empty result, one does not."""
    parsed = v.snaps().withColumn("payload", F.try_parse_json("response_data"))
    items = sn.items_of(F.col("payload"), sn.container_of(F.col("payload"))).cast("array<variant>")
    sized = parsed.withColumn("n_items", F.coalesce(F.size(items), F.lit(0)))
    return sn.storable(sized).select("event_id")


@query(
    "legacy_key_purge",
    "select event_id from snaps where function_name not in ('firecrawl-news', 'telegram-feed')",
    ("snaps",),
)
def legacy_key_purge(v):
    """Snapshots without those still stored under keys from before topics."""
    return sn.purge_keys(v.snaps(), ("firecrawl-news", "telegram-feed")).select("event_id")


@query(
    "urgent_or_all",
    f"""select conflict, pos, level from (select *, max(level in ('critical', 'high')) over (partition by conflict) any_urgent from (
      select conflict || case when pos % 3 = 0 then '-a' else '-b' end conflict, pos, {sql_norm_severity("case when pos % 3 = 0 then 'info' else severity end")} level from items))
    where level in ('critical', 'high') or not any_urgent""",
    ("items",),
)
def urgent_or_all(v):
    """Urgent items of each topic, or everything where nothing is urgent."""
    third = F.col("pos") % 3 == 0
    items = v.items(urls=False).select(
        F.concat("conflict", F.when(third, "-a").otherwise("-b")).alias("conflict"),
        "pos",
        F.when(third, "info").otherwise(F.col("severity")).alias("severity"),
    )
    return it.urgent_or_all(items).select("conflict", "pos", it.norm_severity(F.col("severity")).alias("level"))


@query("critical_items", f"select conflict, pos from items where {sql_norm_severity('severity')} = 'critical'", ("items",))
def critical_items(v):
    return it.critical_only(v.items(urls=False)).select("conflict", "pos")


_ACTIVE = KNOWN_CHANNELS[2:7]


@query("channel_filter", f"select channel, pos from messages where channel in {sql_in(_ACTIVE)}", ("messages",))
def channel_filter(v):
    return it.channel_filter(v.messages(), _ACTIVE).select("channel", "pos")


_PLACEHOLDER_SETS_SQL = """select 'set' || case when pos % 3 = 0 then pos else pos % 50 end as set_id, pos,
  case when pos % 6 = 0 then 'No recent items' when pos % 6 = 1 then 'Data NOT AVAILABLE' else title end title from items"""


@query(
    "placeholder_sets",
    f"""select set_id, pos from (select *, count(*) over (partition by set_id) n from ({_PLACEHOLDER_SETS_SQL}))
    where not (n = 1 and regexp_matches(title, '(?i)(no recent|no data|not available)'))""",
    ("items",),
)
def placeholder_sets(v):
    """Result sets without those that are one "no data" item."""
    p = F.col("pos")
    sets = v.items(labels=False, urls=False).select(
        F.concat(F.lit("set"), F.when(p % 3 == 0, p).otherwise(p % 50)).alias("set_id"),
        "pos",
        F.when(p % 6 == 0, "No recent items").when(p % 6 == 1, "Data NOT AVAILABLE").otherwise(F.col("title")).alias("title"),
    )
    return it.drop_placeholder_sets(sets, "set_id").select("set_id", "pos")


@query(
    "apology_filter",
    """select pos from (select pos, case pos % 5 when 0 then 'No new reports available' when 1 then 'Unable to retrieve ' || title
      when 2 then null else title end t from items)
    where not coalesce(regexp_matches(t, '(?i)(no .*(reports?|results?|data) available|unable to retrieve|couldn''?t find)'), false)""",
    ("items",),
)
def apology_filter(v):
    p = F.col("pos") % 5
    titled = v.items(labels=False, urls=False).select(
        "pos",
        F.when(p == 0, "No new reports available")
        .when(p == 1, F.concat(F.lit("Unable to retrieve "), "title"))
        .when(p != 2, F.col("title"))
        .alias("title"),
    )
    return it.drop_apologies(titled).select("pos")


@query(
    "stance_valid",
    """select pos from (select pos, case when pos % 7 = 0 then '' else title end summary,
      case stance when 'left' then 1 else 0 end l, case stance when 'center' then 1 else 0 end c, case stance when 'right' then 1 else 0 end r from items)
    where summary <> '' and l + c + r > 0""",
    ("items",),
)
def stance_valid(v):
    """Stance records with a summary and at least one counted story."""

    def one(side):
        return F.when(F.col("stance") == side, 1).otherwise(0).alias(f"{side}_count")

    summary = F.when(F.col("pos") % 7 == 0, "").otherwise(F.col("title")).alias("summary")
    return has_content(v.items(urls=False).select("pos", summary, one("left"), one("center"), one("right"))).select("pos")


@query(
    "expire_items",
    f"""select conflict, pos from (select *, {sql_ts('ts_raw')} ts from items)
    where ts is null or ts >= {_NOW} - interval 48 hours""",
    ("items",),
)
def expire_items(v):
    return it.expire_items(v.items(labels=False, urls=False), now(), ITEM_EXPIRY_HOURS).select("conflict", "pos")


@query(
    "stale_snapshots",
    f"""select event_id, not coalesce({sql_ts('cached_at')} >= {_NOW} - interval 24 hours, false) stale from snaps""",
    ("snaps",),
)
def stale_snapshots(v):
    return v.snaps().select("event_id", sn.is_stale_snapshot(F.col("cached_at"), now()).alias("stale"))


@query(
    "orphan_keys",
    """select event_id, function_name, not (split_part(function_name, ':', 1) in
      ('firecrawl-news','analyst-curated','perplexity-osint','telegram-feed','ai-summarize','bias-tracker')
      and (not contains(function_name, ':') or substr(function_name, instr(function_name, ':') + 1) in ('all','iran-us','ukraine-russia','china-taiwan'))) orphan
    from snaps""",
    ("snaps",),
)
def orphan_keys(v):
    return v.snaps().select("event_id", "function_name", sn.is_orphan(F.col("function_name")).alias("orphan"))


@query(
    "translatable",
    r"""select kind, doc, coalesce(s <> '' and not regexp_matches(s, '(?i)^https?://') and not regexp_matches(s, '^\d{4}-\d{2}-\d{2}') and regexp_matches(s, '[A-Za-z]'), false) ok
    from (select kind, doc, case doc % 6 when 0 then '2026-04-28 ' || value when 1 then '١٢ 12:30' when 2 then 'HTTPS://x/' || doc when 3 then null else value end s from leaves)""",
    ("leaves",),
)
def translatable(v):
    d = F.col("doc") % 6
    value = (
        F.when(d == 0, F.concat(F.lit("2026-04-28 "), "value"))
        .when(d == 1, "١٢ 12:30")
        .when(d == 2, F.concat(F.lit("HTTPS://x/"), "doc"))
        .when(d == 3, F.lit(None))
        .otherwise(F.col("value"))
    )
    return v.leaves().select("kind", "doc", is_translatable(value).alias("ok"))


@query(
    "protected_paths",
    f"""select event_id, path, len(list_intersect(string_split(path, '.'), [{", ".join(f"'{k}'" for k in PROTECTED_KEYS)}])) > 0 protected
    from (select event_id, event_type || '.' || case event_id % 4 when 0 then 'source.name' when 1 then 'headline' when 2 then 'items.0.url' else 'meta.sources' end path from events)""",
)
def protected_paths(v):
    i = F.col("event_id") % 4
    kind = F.col("event_type")
    steps = (
        F.when(i == 0, F.array(kind, F.lit("source"), F.lit("name")))
        .when(i == 1, F.array(kind, F.lit("headline")))
        .when(i == 2, F.array(kind, F.lit("items"), F.lit("0"), F.lit("url")))
        .otherwise(F.array(kind, F.lit("meta"), F.lit("sources")))
    )
    paths = v.table("events", "event_id", "event_type").select("event_id", steps.alias("steps"))
    return paths.select("event_id", F.array_join("steps", ".").alias("path"), tr.protected_path(F.col("steps")).alias("protected"))


@query(
    "untranslated",
    f"""select memory_id, coalesce(translation = '' or {sql_trim('translation')} = {sql_trim('value')}, true) retry
    from (select memory_id, value, case when memory_id % 11 = 0 then null when memory_id % 13 = 0 then ' ' || value || chr(10) else translation end translation from memory)""",
    ("memory",),
)
def untranslated(v):
    m = F.col("memory_id")
    got = (
        F.when(m % 11 == 0, F.lit(None))
        .when(m % 13 == 0, F.concat(F.lit(" "), "value", F.lit("\n")))
        .otherwise(F.col("translation"))
    )
    return v.memory().select("memory_id", tr.needs_retry(F.col("value"), got).alias("retry"))


@query(
    "topic_relevance",
    r"""with padded as (select conflict, pos, ' ' || trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' p from items),
    terms as (select conflict, list_distinct(list_filter(list_transform(string_split(search_terms, ','),
      lambda t: ' ' || trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '), lambda t: length(trim(t)) > 0)) ts from config)
    select conflict, pos, cast(len(list_filter(ts, lambda t: contains(p, t))) as bigint) n_terms from padded join terms using (conflict)""",
    ("items", "config"),
)
def topic_relevance(v):
    """Search terms of the item's topic found in its whole text."""
    scored = relevance(v.items(labels=False, urls=False), v.config(), "body")
    return scored.select("conflict", "pos", F.col("n_terms").cast("bigint").alias("n_terms"))


@query(
    "payload_strip",
    """select event_id, cast(len(json_keys(response_data)) - case when json_exists(response_data, '$.cached_at') then 1 else 0 end as bigint) n_fields
    from snaps where json_type(response_data) = 'OBJECT'""",
    ("snaps",),
)
def payload_strip(v):
    """Fields left in each object payload once its write time is removed."""
    stripped = v.snaps().withColumn("rest", sn.strip_cached_at(F.col("response_data"))).filter(F.col("rest").isNotNull())
    return stripped.select("event_id", F.size(F.json_object_keys("rest")).cast("bigint").alias("n_fields"))


@query("size_guard", "select doc_id, case when length(text) <= 50000 then 'ok' else 'too_large' end verdict, case when length(text) <= 2000 then 'ok' else 'too_large' end strict from documents")
def size_guard(v):
    docs = v.table("documents", "doc_id", "text")
    return docs.select(
        "doc_id", tr.size_guard(F.col("text")).alias("verdict"), tr.size_guard(F.col("text"), 2000).alias("strict")
    )


@query(
    "recency",
    f"""select conflict, pos, age <= 14::bigint * 86400000 preferred from (select *, epoch_ms({_NOW}) - epoch_ms({sql_ts('ts_raw')}) age from items)
    where age <= 31::bigint * 86400000""",
    ("items",),
)
def recency(v):
    items = v.items(labels=False, urls=False)
    days, preferred = RECENCY_DAYS["analyst"], RECENCY_DAYS["analyst_preferred"]
    return it.recency_window(items, now(), days, preferred).select("conflict", "pos", "preferred")


@query(
    "domain_filter",
    r"""select page_id, host from (select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) host from pages)
    where host = 'example.com' or ends_with(host, '.example.com') or host = 'example.org' or ends_with(host, '.example.org')""",
)
def domain_filter(v):
    kept = it.domain_filter(v.table("pages", "page_id", "url"), ("example.com", "example.org"))
    return kept.select("page_id", "host")
