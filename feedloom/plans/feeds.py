"""Panel feeds, from recovered items to display order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.json_values import recover
from feedloom.functions.labels import norm_confidence, norm_severity
from feedloom.operators import items as it
from feedloom.operators.near_dupes import dedupe_titles
from feedloom.operators.pages import assemble_corpus, first_sources, load_pages
from feedloom.operators.roster import roster_match
from feedloom.operators.stance import has_content, parse_stance, spectrum, with_clean_summary
from feedloom.operators.snapshots import base_of, explode_snapshots, newest_is_fresh, suffix_of
from feedloom.session import cut_lineage, small_side
from feedloom.sources.topics import CHANNEL_BASE, CHANNEL_TAIL_CHARS, CORPUS_STYLE, HEAD_CHARS, ITEM_CAPS, LATEST_MESSAGES, SOURCES_PER_TOPIC


def timeline(items: DataFrame, config: DataFrame, today: str, **options) -> DataFrame:
    """Dated items of each topic since its start, near-duplicates removed, in
    (topic, raw timestamp, position) order."""
    return dedupe_titles(it.in_date_range(items, config, today), **options).orderBy("conflict", "ts_raw", "pos")


def recover_items(responses: DataFrame, raw: str, container: str, *keep: str) -> DataFrame:
    """Item rows of raw model responses; a response without JSON gives no rows."""
    listed = F.try_variant_get("value", f"$.{container}", "array<variant>")
    return recover(responses, raw).select(*keep, F.posexplode(listed).alias("pos", "item"))


def fields_of(rows: DataFrame, fields: dict[str, str], *keep: str) -> DataFrame:
    """Text fields of VARIANT items; ``fields`` maps output name to JSON name."""
    return rows.select(
        *keep,
        F.col("pos").cast("bigint").alias("pos"),
        *[F.try_variant_get("item", f"$.{name}", "string").alias(out) for out, name in fields.items()],
    )


def corpus(pages: DataFrame, sources: DataFrame, style: str) -> DataFrame:
    """Prompt text per topic from its first few landed sources, or from all its channels.

    ``pages`` is ``(url, html)``, ``sources`` ``(conflict, pos, url)``, or the rows
    of ``derive_all_sources``, ordered by first topic and position.  Sources
    are ranked before pages are read, so only pages in use cross the join.  The
    curated channels of a topic are few and all of them are read.
    """
    n, mode = (CHANNEL_TAIL_CHARS, "tail") if style == "channel" else (HEAD_CHARS[style], "head")
    order = ("first_ord", "first_pos") if "first_ord" in sources.columns else ("pos",)
    chosen = first_sources(sources, None if style == "channel" else SOURCES_PER_TOPIC, order=order)
    texts = load_pages(pages.join(chosen, "url"), n, mode)
    return assemble_corpus(texts.select("conflict", "rank", F.col("url").alias("source"), "text"), style)


def channel_digest(halves: list[DataFrame], k: int = LATEST_MESSAGES) -> DataFrame:
    """Messages of all halves, the newest ``k`` per topic."""
    merged = halves[0]
    for half in halves[1:]:
        merged = merged.unionByName(half)
    return it.latest_messages(merged, k)


def fresh_channel_snapshots(store: DataFrame, now: Column) -> DataFrame:
    """``conflict, pos, item`` of the channel snapshots whose newest post is recent enough."""
    channel = store.filter(base_of(F.col("function_name")) == CHANNEL_BASE)
    items = explode_snapshots(channel, ("messages",))
    newest = it.newest_ts(items, "function_name").filter(newest_is_fresh(F.col("newest"), now))
    return items.join(small_side(newest.select("function_name")), "function_name", "left_semi").select(
        suffix_of(F.col("function_name")).alias("conflict"), "pos", "item"
    )


def channel_requests(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """``conflict, half, corpus``: the channels' posts of each topic, in two halves if there are two.

    ``pages`` is ``(url, html)``, ``sources`` the curated ``(conflict, pos, url)``. Halves
    are cut by what was landed, the first is the longer one.
    """
    landed = load_pages(pages.join(sources, "url"), CHANNEL_TAIL_CHARS, "tail")
    before, after, separator = CORPUS_STYLE["channel"]
    part = F.concat(F.lit(before), "url", F.lit(after), "text")
    # A topic's channels are few: the curated list.
    parts = landed.groupBy("conflict").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))
    cut = F.ceil(F.size("parts") / 2).cast("int")
    halves = F.filter(
        F.array(F.slice("parts", F.lit(1), cut), F.slice("parts", cut + 1, F.size("parts"))), lambda h: F.size(h) > 0
    )
    return parts.select("conflict", F.posexplode(halves).alias("half", "some")).select(
        "conflict", "half", F.array_join(F.transform("some", lambda p: p["part"]), separator).alias("corpus")
    )


def channel_refresh(
    store: DataFrame,
    pages: DataFrame,
    sources: DataFrame,
    ask: Callable[[DataFrame], DataFrame],
    now: Column,
    k: int = LATEST_MESSAGES,
) -> DataFrame:
    """``conflict, origin, rank, channel, text, ts_raw``: every topic's newest ``k`` messages.

    A topic whose stored snapshot is fresh is served from it. For the others ``ask``
    turns requests (``conflict, half, corpus``) into responses (``conflict, half,
    content``), whose messages are put together half by half. Pages of topics that are
    served from the store are not read.
    """
    stored = fresh_channel_snapshots(store, now)
    served = cut_lineage(stored.select("conflict").distinct())
    due = sources.join(small_side(served), "conflict", "left_anti")
    responses = ask(channel_requests(pages, due))
    names = {"channel": "channel", "text": "text", "ts_raw": "timestamp"}
    asked = fields_of(recover_items(responses, "content", "messages", "conflict", "half"), names, "conflict", "half")
    newest = it.top_k(asked, k, F.coalesce("ts_raw", F.lit("")).desc(), F.col("half"), F.col("pos"))
    cached = fields_of(stored, names, "conflict").withColumn("rank", F.col("pos") + 1)
    columns = ("conflict", "rank", "channel", "text", "ts_raw")
    return cached.select(F.lit("stored").alias("origin"), *columns).unionByName(newest.select(F.lit("asked").alias("origin"), *columns))


def osint_feed(responses: DataFrame, stored: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """Recovered items with a valid URL, else the stored ones; placeholders and
    apologies dropped; newest first within each key.

    ``stored`` is ``(key, pos, title, url, confidence, ts_raw)``.
    """
    names = {"title": "title", "url": "url", "confidence": "confidence", "ts_raw": "timestamp"}
    fresh = it.require_url(fields_of(recover_items(responses, raw, "items", key), names, key))
    old = stored.join(fresh.select(key).distinct(), key, "left_anti")
    rows = fresh.withColumn("origin", F.lit("fresh")).unionByName(
        old.select(*fresh.columns).withColumn("origin", F.lit("stale"))
    )
    shown = it.drop_apologies(it.drop_placeholder_sets(rows, key))
    return it.osint_order(shown.withColumn("confidence", norm_confidence(F.col("confidence"))))


def analyst_feed(responses: DataFrame, roster: DataFrame, raw: str = "raw") -> DataFrame:
    """Recovered comments by roster members under their canonical names."""
    names = {"author": "analyst", "affiliation": "affiliation", "comment": "comment", "ts_raw": "timestamp"}
    keep = ("conflict", "response_id")
    return roster_match(fields_of(recover_items(responses, raw, "comments", *keep), names, *keep), roster)


def stance_report(responses: DataFrame, config: DataFrame, now_iso: str, raw: str = "raw") -> DataFrame:
    """Stance records with content, topic labels and display shares."""
    parsed = recover(responses, raw).drop(raw, "stage")
    records = with_clean_summary(has_content(parse_stance(parsed, "value", now_iso)))
    labels = config.select("conflict", "label", "left_label", "center_label", "right_label")
    return spectrum(records.join(small_side(labels), "conflict"))


def news_digest(responses: DataFrame, raw: str = "raw", k: int = ITEM_CAPS["news"]) -> DataFrame:
    """Most important recovered stories per topic, severity normalised, urgent
    ones only where there are any."""
    names = {"title": "headline", "severity": "severity", "ts_raw": "timestamp", "url": "url"}
    keep = ("conflict", "response_id")
    stories = fields_of(recover_items(responses, raw, "stories", *keep), names, *keep)
    stories = stories.withColumn("severity", norm_severity(F.col("severity")))
    ranked = it.top_k(
        stories,
        k,
        it.severity_rank(F.col("severity")).desc(),
        F.coalesce("ts_raw", F.lit("")).desc(),
        F.col("response_id"),
        F.col("pos"),
    )
    # A handful of rows a topic, read twice: stored, so that responses are parsed once.
    return it.urgent_or_all(cut_lineage(ranked))


__all__ = [
    "analyst_feed",
    "channel_digest",
    "channel_refresh",
    "channel_requests",
    "corpus",
    "fields_of",
    "news_digest",
    "osint_feed",
    "recover_items",
    "stance_report",
    "timeline",
]
