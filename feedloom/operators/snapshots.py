"""Snapshot freshness, upsert, fallback, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.times import millis, parse_ts
from feedloom.operators.items import dedupe_identity, expire_items
from feedloom.sources.topics import (
    AUDITED_BASES,
    CHANNEL_BASE,
    DEFAULT_TTL_MS,
    FEED_OF_BASE,
    FORCED_TTL_MS,
    ITEM_EXPIRY_HOURS,
    NEWEST_POST_MS,
    SNAPSHOT_BASES,
    SNAPSHOT_EXPIRY_HOURS,
    STANCE_TTL_MS,
    STORE_EMPTY,
    TOPIC_KEYS,
    UNSUFFIXED_LEGACY_KEYS,
)

# Item lists a snapshot may hold, in the order they are looked for.
LEGACY_CONTAINERS = ("items", "data")
CONTAINERS = LEGACY_CONTAINERS + ("stories", "messages", "topics", "comments")


# -- keys ----------------------------------------------------------------------


def base_of(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def suffix_of(key: Column) -> Column:
    """Everything after the first colon; null for a bare key."""
    at = F.instr(key, ":")
    return F.when(at > 0, F.substring(key, at + 1, F.length(key)))


def is_orphan(key: Column) -> Column:
    known = base_of(key).isin(*SNAPSHOT_BASES)
    suffix = suffix_of(key)
    return ~(known & (suffix.isNull() | suffix.isin(*TOPIC_KEYS)))


def candidate_keys(bases: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Bare bases and every base with every distinct suffix.

    The result is that product, dealt by base and suffix: both sides are spread over
    ``lots`` and met lot by lot, so neither is gathered in one value or task.
    """
    lots = 16
    lot = F.array(*[F.lit(i) for i in range(lots)])
    left = bases.select("base", F.pmod(F.xxhash64("base"), F.lit(lots)).alias("i"), F.explode(lot).alias("j"))
    right = suffixes.select("suffix").distinct()
    right = right.select("suffix", F.explode(lot).alias("i"), F.pmod(F.xxhash64("suffix"), F.lit(lots)).alias("j"))
    paired = left.join(right, [left["i"] == right["i"], left["j"] == right["j"]]).select(
        F.concat_ws(":", "base", "suffix").alias("function_name")
    )
    return bases.select(F.col("base").alias("function_name")).unionByName(paired)


# -- payloads ------------------------------------------------------------------


def has_array(payload: Column, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{name}", "variant"))
    return F.coalesce(kind.startswith("ARRAY"), F.lit(False))


def container_of(payload: Column, names: tuple[str, ...] = CONTAINERS) -> Column:
    """Where the items sit: ``array``, one of ``names``, or ``none``."""
    found = F.when(F.schema_of_variant(payload).startswith("ARRAY"), "array")
    for name in names:
        found = found.when(has_array(payload, name), name)
    return found.otherwise("none")


def items_of(payload: Column, container: Column, names: tuple[str, ...] = CONTAINERS) -> Column:
    items = F.when(container == "array", payload)
    for name in names:
        items = items.when(container == name, F.try_variant_get(payload, f"$.{name}", "variant"))
    return items


def explode_snapshots(
    snapshots: DataFrame, names: tuple[str, ...] = CONTAINERS, keep: tuple[str, ...] = (), outer: bool = False
) -> DataFrame:
    """Item rows of each snapshot with their position; ``outer`` keeps empty snapshots."""
    parsed = snapshots.withColumn("payload", F.try_parse_json("response_data"))
    parsed = parsed.withColumn("container", container_of(F.col("payload"), names))
    items = items_of(F.col("payload"), F.col("container"), names).cast("array<variant>")
    unnest = F.posexplode_outer if outer else F.posexplode
    rows = parsed.select("function_name", "container", *keep, unnest(items).alias("pos", "item"))

    def text(*fields: str) -> Column:
        return F.coalesce(*[F.try_variant_get("item", f"$.{f}", "string") for f in fields])

    return rows.select(
        "function_name",
        "container",
        *keep,
        F.col("pos").cast("bigint").alias("pos"),
        "item",
        text("url").alias("url"),
        text("headline", "title").alias("title"),
        text("text").alias("body"),
        text("timestamp", "published_at").alias("ts_raw"),
    )


def strip_cached_at(payload: Column) -> Column:
    """Payload without its bookkeeping field, as JSON text."""
    every = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    fields = F.map_filter(every, lambda k, v: k != "cached_at")
    return F.to_json(fields)


def wrap_payload(value: Column, cached_at: Column) -> Column:
    """Object payloads get the field added; anything else is wrapped in ``data``."""
    parsed = F.try_parse_json(value)
    stamp = F.to_json(F.struct(cached_at.alias("cached_at")))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    body = F.trim(value)
    inner = F.substring(body, 2, F.length(body) - 2)
    comma = F.when(F.trim(inner) == "", F.lit("")).otherwise(F.lit(","))
    stamp_inner = F.substring(stamp, 2, F.length(stamp) - 2)
    return F.when(is_object, F.concat(F.lit("{"), inner, comma, stamp_inner, F.lit("}"))).otherwise(
        F.concat(F.lit('{"data":'), F.coalesce(body, F.lit("null")), F.lit(","), stamp_inner, F.lit("}"))
    )


# -- freshness -----------------------------------------------------------------


def is_fresh(cached_at: Column, max_age_ms: Column, now: Column) -> Column:
    """Younger than the limit.  Unreadable is stale; a future stamp is fresh."""
    return F.coalesce(millis(now) - millis(parse_ts(cached_at)) < max_age_ms, F.lit(False))


def effective_max_age(base: Column, forced: Column) -> Column:
    ordinary = F.when(base == "bias-tracker", F.lit(STANCE_TTL_MS)).otherwise(F.lit(DEFAULT_TTL_MS))
    return F.when(forced, F.lit(FORCED_TTL_MS)).otherwise(ordinary)


def newest_is_fresh(newest: Column, now: Column) -> Column:
    """The newest item is at most two hours old."""
    return F.coalesce(millis(now) - millis(parse_ts(newest)) <= NEWEST_POST_MS, F.lit(False))


def is_stale_snapshot(cached_at: Column, now: Column, hours: int = SNAPSHOT_EXPIRY_HOURS) -> Column:
    age = millis(now) - millis(parse_ts(cached_at))
    return ~F.coalesce(age <= hours * 3_600_000, F.lit(False))


# -- table changes ---------------------------------------------------------------


def keep_latest(history: DataFrame, *order: str) -> DataFrame:
    """Last write per key.  A partial aggregate: a hot key ships one row per task."""
    rest = [c for c in history.columns if c != "function_name"]
    return (
        history.groupBy("function_name")
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
        .select("function_name", *[F.col("last")[c].alias(c) for c in rest])
    )


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes win over stored rows; among changes the last one wins."""
    tagged = store.withColumn("generation", F.lit(0)).unionByName(changes.withColumn("generation", F.lit(1)))
    return keep_latest(tagged, "generation", "fetched_at", "cached_at", "response_data").drop("generation")


def delete_keys(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("function_name"), "function_name", "left_anti")


def purge_keys(store: DataFrame, keys: tuple[str, ...] = UNSUFFIXED_LEGACY_KEYS) -> DataFrame:
    """Drop a few fixed keys with a plain filter."""
    return store.filter(~F.col("function_name").isin(*keys))


def storable(refreshed: DataFrame) -> DataFrame:
    """Refreshes to keep: those with items, and empty ones of feeds that store them."""
    drops_empty = [base for base, feed in FEED_OF_BASE.items() if not STORE_EMPTY[feed]]
    return refreshed.filter((F.col("n_items") > 0) | ~base_of(F.col("function_name")).isin(*drops_empty))


def stale_fallback(fresh: DataFrame, stored: DataFrame, key: str = "function_name") -> DataFrame:
    """Fresh payload if there is one, else the stored one of any age, else empty."""
    new = fresh.select(key, F.col("payload").alias("new_payload"))
    old = stored.select(key, F.col("payload").alias("old_payload"))
    return new.join(old, key, "full_outer").select(
        key,
        F.coalesce("new_payload", "old_payload").alias("payload"),
        F.when(F.col("new_payload").isNotNull(), "fresh")
        .when(F.col("old_payload").isNotNull(), "stale")
        .otherwise("empty")
        .alias("origin"),
    )


def evicted_channel_keys(store: DataFrame, newest: DataFrame, now: Column) -> DataFrame:
    """Keys to delete when any channel snapshot went stale: all of that base.

    ``newest`` is ``(function_name, newest)``; the verdict is one subquery.
    """
    channel = store.filter(base_of(F.col("function_name")) == CHANNEL_BASE).select("function_name")
    suffixed = channel.filter(suffix_of(F.col("function_name")).isin(*TOPIC_KEYS))
    stale = suffixed.join(newest, "function_name", "left").filter(~newest_is_fresh(F.col("newest"), now))
    return suffixed.filter(stale.exists())


# -- audit -----------------------------------------------------------------------


def clean_snapshots(
    store: DataFrame, now: Column, names: tuple[str, ...] = CONTAINERS, hours: int = ITEM_EXPIRY_HOURS
) -> tuple[DataFrame, DataFrame]:
    """Expire and de-duplicate the items of the audited snapshots.

    Returns the surviving item rows and ``(function_name, before, after)``.
    """
    audited = store.filter(base_of(F.col("function_name")).isin(*AUDITED_BASES) & ~is_orphan(F.col("function_name")))
    rows = explode_snapshots(audited, names)
    cleaned = dedupe_identity(expire_items(rows, now, hours), "function_name")
    before = rows.groupBy("function_name").agg(F.count(F.lit(1)).alias("before"))
    after = cleaned.groupBy("function_name").agg(F.count(F.lit(1)).alias("after"))
    counts = before.join(after, "function_name", "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return cleaned, counts


def rebuild_snapshots(store: DataFrame, cleaned: DataFrame, names: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """Write cleaned items and the row's write time back into the payloads; other fields stay.

    A payload holds one feed's capped list, so collecting it per key is small.
    """
    lists = cleaned.groupBy("function_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json("item").alias("json")))), lambda i: i["json"]).alias(
            "jsons"
        )
    )
    parsed = store.withColumn("payload", F.try_parse_json("response_data"))
    parsed = parsed.withColumn("container", container_of(F.col("payload"), names)).join(lists, "function_name", "left")
    body = F.concat(F.lit("["), F.array_join(F.coalesce("jsons", F.array().cast("array<string>")), ","), F.lit("]"))
    target = F.when(F.col("container") == "array", F.lit("data")).otherwise(F.col("container"))
    others = F.map_filter(
        F.try_variant_get("payload", "$", "map<string,variant>"), lambda k, v: (k != target) & (k != "cached_at")
    )
    stamp = F.try_variant_get(F.try_parse_json(F.to_json(F.struct("cached_at"))), "$.cached_at", "variant")
    fields = F.map_concat(
        F.coalesce(others, F.create_map().cast("map<string,variant>")),
        F.create_map(target, F.try_parse_json(body), F.lit("cached_at"), stamp),
    )
    rebuilt = F.when(F.col("container") == "none", F.col("response_data")).otherwise(F.to_json(fields))
    return parsed.withColumn("response_data", rebuilt).drop("payload", "container", "jsons")


def stamp_touched(store: DataFrame, counts: DataFrame, now: Column) -> DataFrame:
    """The store with ``touched``: which snapshots the audit rewrites.

    A rewritten snapshot that has no write time gets the audit's.
    """
    touched = counts.select("function_name", F.lit(True).alias("touched"))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    marked = store.join(touched, "function_name", "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    return marked.withColumn("cached_at", F.coalesce("cached_at", F.when(F.col("touched"), stamp)))


def snapshot_verdict(now: Column) -> Column:
    """Why a snapshot would be deleted; an orphan counts as orphan even if stale."""
    return (
        F.when(is_orphan(F.col("function_name")), "orphan")
        .when(is_stale_snapshot(F.col("cached_at"), now), "stale")
        .otherwise("keep")
    )


def snapshot_verdicts(store: DataFrame, now: Column) -> DataFrame:
    return store.select("function_name", snapshot_verdict(now).alias("verdict"))


def audit_report(counts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: items before, after, removed, snapshots deleted by reason."""
    def number(verdict: str) -> Column:
        return verdicts.agg(F.count_if(F.col("verdict") == verdict)).scalar()

    return counts.agg(
        F.count(F.lit(1)).alias("audited"),
        F.coalesce(F.sum("before"), F.lit(0)).alias("items_before"),
        F.coalesce(F.sum("after"), F.lit(0)).alias("items_after"),
    ).select(
        "*",
        (F.col("items_before") - F.col("items_after")).alias("removed"),
        number("stale").alias("deleted_stale"),
        number("orphan").alias("deleted_orphaned"),
    )
