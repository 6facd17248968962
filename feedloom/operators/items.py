"""Item tables: predicates, ranking, identity de-duplication, envelopes.

Items carry ``conflict, pos, title, body, ts_raw, severity, url`` and whatever
else a feed adds; ``pos`` is the position in the item's own list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.labels import URGENT, norm_severity, severity_rank
from feedloom.functions.text import APOLOGY_TITLE, PLACEHOLDER_TITLE, is_http_url, squeezed, trimmed
from feedloom.functions.times import millis, parse_ts
from feedloom.session import cut_lineage, small_side
from feedloom.sources.topics import ALL, SOURCE_DOMAINS, TOPIC_KEYS


def normalize_conflict(conflict: Column) -> Column:
    return F.when(conflict.isin(*TOPIC_KEYS), conflict).otherwise(F.lit(ALL))


def require_url(items: DataFrame) -> DataFrame:
    return items.filter(is_http_url(F.col("url")))


def in_date_range(items: DataFrame, starts: DataFrame, today: str) -> DataFrame:
    """Keep items between their topic's start date and the end of ``today``.

    ``starts`` is the topic dimension (``conflict, start_date``).
    """
    ts = parse_ts(F.col("ts_raw"))
    last = F.lit(f"{today} 23:59:59").cast("timestamp")
    return (
        items.filter((F.col("ts_raw") != "") & ts.isNotNull() & (ts <= last))
        .join(small_side(starts.select("conflict", "start_date")), "conflict")
        .filter(parse_ts(F.col("ts_raw")) >= F.col("start_date").cast("timestamp"))
        .drop("start_date")
    )


def expire_items(items: DataFrame, now: Column, hours: int) -> DataFrame:
    """Drop items older than ``hours``; an unreadable timestamp is no reason to."""
    cutoff = millis(now) - F.lit(hours * 3_600_000)
    ts = parse_ts(F.col("ts_raw"))
    return items.filter(ts.isNull() | (millis(ts) >= cutoff))


def recency_window(items: DataFrame, now: Column, days: int, preferred_days: int | None = None) -> DataFrame:
    """Items of the last ``days`` days, flagged when inside ``preferred_days``."""
    age = millis(now) - millis(parse_ts(F.col("ts_raw")))
    day = 86_400_000
    kept = items.filter(age <= days * day)
    if preferred_days is None:
        return kept
    return kept.withColumn("preferred", age <= preferred_days * day)


def domain_filter(items: DataFrame, domains: tuple[str, ...] = SOURCE_DOMAINS) -> DataFrame:
    """Keep URLs whose host is one of ``domains`` or below one of them."""
    host = F.lower(F.try_parse_url(trimmed(F.col("url")), F.lit("HOST")))
    hit = F.lit(False)
    for domain in domains:
        hit = hit | (host == domain) | host.endswith(f".{domain}")
    return items.withColumn("host", host).filter(F.coalesce(hit, F.lit(False)))


def critical_only(items: DataFrame) -> DataFrame:
    return items.filter(norm_severity(F.col("severity")) == "critical")


def urgent_or_all(items: DataFrame, group: str = "conflict") -> DataFrame:
    """Urgent items of each topic, or all its items when it has none.

    The per-topic flags are a partial aggregate, stored once and joined back, so a
    topic with a third of all rows never sits in one task.
    """
    urgent = norm_severity(F.col("severity")).isin(*URGENT)
    flags = cut_lineage(items.groupBy(group).agg(F.bool_or(urgent).alias("any_urgent")))
    return items.join(small_side(flags), group).filter(urgent | ~F.col("any_urgent")).drop("any_urgent")


def channel_filter(messages: DataFrame, active: tuple[str, ...]) -> DataFrame:
    return messages.filter(F.col("channel").isin(*active))


def drop_placeholder_sets(items: DataFrame, key: str) -> DataFrame:
    """Drop a set that is a single "no data" item; longer sets stay whole."""
    placeholder = F.coalesce(F.col("title").rlike(PLACEHOLDER_TITLE), F.lit(False))
    sizes = items.groupBy(key).agg(F.count(F.lit(1)).alias("set_size"))
    return items.join(sizes, key).filter(~((F.col("set_size") == 1) & placeholder)).drop("set_size")


def drop_apologies(items: DataFrame) -> DataFrame:
    return items.filter(~F.coalesce(F.col("title").rlike(APOLOGY_TITLE), F.lit(False)))


def identity_key(url: Column, *names: Column) -> Column:
    """First non-null of url and names, squeezed.  A blank url hides the names."""
    return squeezed(F.coalesce(url, *names, F.lit("")))


def dedupe_identity(items: DataFrame, group: str, skip_blank_url: bool = False) -> DataFrame:
    """Keep the first item of each identity in list order; blank identities stay.

    A blank identity is grouped with its own position, so those rows spread out
    instead of meeting in one group, and the rank filter stays a plain "first of
    group" that Spark limits before the shuffle, however many copies there are.
    """
    url = F.when(trimmed(F.col("url")) != "", F.col("url")) if skip_blank_url else F.col("url")
    keyed = items.withColumn("identity", identity_key(url, F.col("title"), F.col("body")))
    alone = F.when(F.col("identity") == "", F.col("pos"))
    w = Window.partitionBy(group, "identity", alone).orderBy("pos")
    return keyed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == 1).drop("rank")


def top_k(items: DataFrame, k: int, *order: Column, group: str = "conflict") -> DataFrame:
    """First ``k`` rows of each group; limited per partition before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def latest_messages(messages: DataFrame, k: int) -> DataFrame:
    """Newest by raw timestamp text, missing last, ties in list order."""
    return top_k(messages, k, F.coalesce("ts_raw", F.lit("")).desc(), F.col("pos"))


def top_k_per_topic(items: DataFrame, k: int) -> DataFrame:
    """Most important first: severity, then newest, then list order."""
    return top_k(
        items, k, severity_rank(F.col("severity")).desc(), F.coalesce("ts_raw", F.lit("")).desc(), F.col("pos")
    )


def osint_order(items: DataFrame) -> DataFrame:
    """Newest by parsed time; a missing or unreadable time counts as 1970."""
    epoch = F.lit("1970-01-01").cast("timestamp")
    return items.withColumn("sort_ts", F.coalesce(parse_ts(F.col("ts_raw")), epoch)).orderBy(
        F.col("sort_ts").desc(), "pos"
    )


def newest_ts(items: DataFrame, key: str) -> DataFrame:
    """Largest raw timestamp text per key; blanks do not count."""
    return items.groupBy(key).agg(F.max(F.when(F.col("ts_raw") != "", F.col("ts_raw"))).alias("newest"))


def emit_envelope(items: DataFrame, group: str, container: str, fields: tuple[str, ...]) -> DataFrame:
    """One JSON envelope per group from rows that already carry a dense ``rank``.

    Feeds are capped before they are stored, so the list is a handful of items;
    apply ``top_k`` first.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    bare = F.transform(listed, lambda i: F.struct(*[i[f].alias(f) for f in fields]))
    return items.groupBy(group).agg(
        F.to_json(F.struct(bare.alias(container))).alias("payload"), F.count(F.lit(1)).alias("n_items")
    )
