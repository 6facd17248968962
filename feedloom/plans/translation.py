"""Translate item tables from a memory, and whole JSON documents through a translator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.json_values import recover
from feedloom.functions.text import latin_digits, trimmed
from feedloom.operators.translate import (
    chunk_leaves,
    field_leaves,
    json_leaves,
    label_translate,
    needs_retry,
    rebuild_documents,
    rebuild_rows,
    size_guard,
    translation_merge,
    translation_usable,
)
from feedloom.session import cut_lineage
from feedloom.sources.topics import LEAVES_PER_CHUNK, LEAVES_PER_RETRY, PAYLOAD_LIMIT

# Requests are ``doc, round, chunk, mapping`` (a JSON object of leaf ids and texts); responses add
# ``attempt`` (from 0), ``status`` (of HTTP) and ``content``, what the model wrote.
Translator = Callable[[DataFrame], DataFrame]
ATTEMPTS = 2
GIVE_UP = (402, 429)  # no credits, too many requests
STANCE_LABELS = ("left_label", "center_label", "right_label", "label")
STANCE_TEXTS = ("summary", "top_left_story", "top_center_story", "top_right_story")


def translate_items(
    rows: DataFrame, memory: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]
) -> DataFrame:
    """Each translatable field replaced by its translation, when there is one."""
    merged = translation_merge(field_leaves(rows, keys, fields), memory)
    return rebuild_rows(rows, merged, keys, fields)


def requests_of(chunked: DataFrame, doc: str, number: int) -> DataFrame:
    """One request a chunk, its texts in order."""
    parts = F.array_sort(F.collect_list(F.struct("leaf", "leaf_id", "value")))
    pairs = F.transform(parts, lambda p: F.struct(p["leaf_id"].alias("key"), p["value"].alias("value")))
    return (
        chunked.groupBy(doc, "chunk")
        .agg(F.to_json(F.map_from_entries(pairs)).alias("mapping"))
        .select(doc, F.lit(number).alias("round"), "chunk", "mapping")
    )


def chunk_results(responses: DataFrame, doc: str) -> DataFrame:
    """``doc, chunk, gave_up, texts``: the first attempt of a chunk that decides it.

    An attempt decides if it gives up or if its content holds a JSON object; other
    failures leave the chunk to the next attempt. Values that are no text are ignored.
    """
    tried = recover(responses.filter(F.col("attempt") < ATTEMPTS), "content")
    kind = F.schema_of_variant("value")
    gave_up = F.col("status").isin(*GIVE_UP)
    read = (F.col("status") == 200) & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    fields = F.try_variant_get("value", "$", "map<string,variant>")
    texts = F.map_filter(
        F.transform_values(fields, lambda _, x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))),
        lambda _, x: x.isNotNull(),
    )
    return (
        tried.select(doc, "chunk", "attempt", gave_up.alias("gave_up"), F.when(read, texts).alias("texts"), F.coalesce(read, F.lit(False)).alias("read"))
        .filter("gave_up or read")
        .groupBy(doc, "chunk")
        .agg(F.min_by(F.struct("gave_up", "texts"), "attempt").alias("first"))
        .select(doc, "chunk", "first.gave_up", "first.texts")
    )


def _got(chunked: DataFrame, results: DataFrame, doc: str) -> DataFrame:
    """Leaves with what came back for them: null where nothing usable did."""
    text = F.try_element_at("texts", F.col("leaf_id"))
    joined = chunked.join(results.select(doc, "chunk", "texts"), [doc, "chunk"], "left")
    return joined.withColumn("got", F.when(trimmed(text) != "", text)).drop("texts")


def translate_documents(
    docs: DataFrame, doc: str, json_col: str, translator: Translator, limit: int = PAYLOAD_LIMIT
) -> DataFrame:
    """``doc, status, payload``: every JSON document with its texts translated.

    Texts are numbered in document order and sent in chunks. Those that did not come
    back, or came back unchanged, are sent once more in smaller chunks. Digits become
    Latin ones. ``status`` is ``translated``, ``nothing`` (no text to translate),
    ``too_large``, ``invalid`` or ``gave_up``; where no usable translation exists, the
    payload is the original text. ``doc`` must be unique.
    """
    sized = docs.select(doc, json_col, size_guard(F.col(json_col), limit).alias("__size"))
    fitting = sized.filter("__size = 'ok'").select(doc, json_col)
    leaves = json_leaves(fitting, doc, json_col).select(doc, "leaf", "value")
    first = leaves.select(
        "*", F.concat(F.lit("v"), "leaf").alias("leaf_id"), F.floor(F.col("leaf") / LEAVES_PER_CHUNK).alias("chunk")
    )
    first = cut_lineage(first)
    # Checkpointed: a translator's answers must not be asked for again.
    results = cut_lineage(chunk_results(translator(requests_of(first, doc, 1)), doc))
    lost = results.groupBy(doc).agg(F.bool_or("gave_up").alias("gave_up")).filter("gave_up")
    once = _got(first, results, doc).join(lost, doc, "left_anti")
    once = cut_lineage(once.withColumn("text", F.coalesce("got", "value")))

    stale = once.filter(needs_retry(F.col("value"), F.col("got"))).select(doc, "leaf", "value")
    again = chunk_leaves(stale, doc, "leaf", LEAVES_PER_RETRY).drop("n").withColumn("leaf_id", F.concat(F.lit("v"), "leaf"))
    again = cut_lineage(again)
    retried = cut_lineage(chunk_results(translator(requests_of(again, doc, 2)), doc))
    better = _got(again, retried.filter("not gave_up"), doc).filter(~needs_retry(F.col("value"), F.col("got")))
    final = once.join(better.select(doc, "leaf", F.col("got").alias("better")), [doc, "leaf"], "left").select(
        doc, "leaf", latin_digits(F.coalesce("better", "text")).alias("result")
    )

    rebuilt = rebuild_documents(fitting, doc, json_col, final)
    known = leaves_of(first, doc)
    state = (
        sized.join(rebuilt, doc, "left").join(known, doc, "left").join(lost, doc, "left")
        .withColumn(
            "status",
            F.when(F.col(json_col).isNull(), "invalid")
            .when(F.col("__size") != "ok", "too_large")
            .when(F.col("rebuilt").isNull(), "invalid")
            .when(F.col("n_leaves").isNull(), "nothing")
            .when(F.col("gave_up"), "gave_up")
            .otherwise("translated"),
        )
    )
    state = cut_lineage(state.select(doc, json_col, "rebuilt", "status"))
    done = state.filter("status = 'translated'")
    usable = translation_usable(done.select(doc, json_col), done.select(doc, F.col("rebuilt").alias(json_col)), doc, json_col)
    return state.join(usable.filter("usable").select(doc, F.lit(True).alias("usable")), doc, "left").select(
        doc, "status", F.when(F.col("usable"), F.col("rebuilt")).otherwise(F.col(json_col)).alias("payload")
    )


def leaves_of(leaves: DataFrame, doc: str) -> DataFrame:
    return leaves.groupBy(doc).agg(F.count("*").alias("n_leaves"))


def text_payload(fields: tuple[str, ...]) -> Column:
    """A JSON object of the fields that hold more than white space."""
    return F.to_json(F.struct(*[F.when(trimmed(F.col(f)) != "", F.col(f)).alias(f) for f in fields]))


def translate_stance(reports: DataFrame, key: str, labels: DataFrame, translator: Translator) -> DataFrame:
    """Stance reports with labels from the dictionary, summary and headlines through the translator.

    The texts of a report are one document; a text that has no translation, or whose
    report gave up, stays as it is.
    """
    named = label_translate(reports, labels, tuple(f for f in STANCE_LABELS if f in reports.columns))
    texts = tuple(f for f in STANCE_TEXTS if f in reports.columns)
    payloads = reports.select(key, text_payload(texts).alias("payload"))
    translated = translate_documents(payloads, key, "payload", translator).filter("status = 'translated'").select(key, "payload")
    new = F.from_json("payload", ", ".join(f"{f} string" for f in texts))
    joined = named.join(translated.select(key, new.alias("__new")), key, "left")
    return joined.select(
        *[
            F.coalesce(F.when(trimmed(F.col(f"__new.{c}")) != "", F.col(f"__new.{c}")), F.col(c)).alias(c) if c in texts else F.col(c)
            for c in reports.columns
        ]
    )
