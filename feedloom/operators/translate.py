"""Translatable text: extraction, chunking, merging, usability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.json_walk import leaf_rows, rebuilt_rows
from feedloom.functions.text import is_translatable, latin_digits, trimmed
from feedloom.operators.pages import position_rank
from feedloom.sources.topics import LEAVES_PER_CHUNK, PAYLOAD_LIMIT, PROTECTED_KEYS


def size_guard(payload: Column, limit: int = PAYLOAD_LIMIT) -> Column:
    return F.when(F.length(payload) <= limit, "ok").otherwise("too_large")


def json_leaves(docs: DataFrame, doc: str, json_col: str) -> DataFrame:
    """Every translatable string of a JSON document: ``doc, leaf, steps, path, value``.

    One scan and one parse. ``leaf`` numbers the strings of a document in its order;
    ``steps`` holds keys and positions, ``path`` the same joined by dots. A protected
    key drops its whole subtree; a text that is no JSON has no leaves.
    """
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(doc, json_col).mapInArrow(
        leaf_rows(doc, json_col, frozenset(PROTECTED_KEYS)), f"`{doc}` {kind}, leaf int, steps array<string>, value string"
    )
    return rows.select(doc, "leaf", "steps", F.array_join("steps", ".").alias("path"), "value")


def rebuild_documents(docs: DataFrame, doc: str, json_col: str, results: DataFrame) -> DataFrame:
    """``doc, rebuilt``: each JSON document with the results of its leaves in their places.

    ``results`` is ``(doc, leaf, result)`` with the numbers of ``json_leaves``; leaves
    without a result stay. A document meets its own leaves only, in one shuffle, and
    is walked once in the same order. The text is compact JSON; null if the input is
    none. ``doc`` must be unique.
    """
    kind = docs.schema[doc].dataType.simpleString()
    changes = results.groupBy(doc).agg(F.collect_list(F.struct("leaf", "result")).alias("changes"))
    return (
        docs.select(doc, json_col)
        .join(changes, doc, "left")
        .mapInArrow(rebuilt_rows(doc, json_col, frozenset(PROTECTED_KEYS)), f"`{doc}` {kind}, rebuilt string")
    )


def field_leaves(rows: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Leaves of flat rows with known text columns: one scan, no unions."""
    pairs = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).alias("value")) for f in fields if f not in PROTECTED_KEYS])
    return (
        rows.select(*keys, F.explode(pairs).alias("leaf"))
        .select(*keys, "leaf.path", "leaf.value")
        .filter(is_translatable(F.col("value")))
    )


def protected_path(steps: Column) -> Column:
    """A path, given as its steps, leads through a protected key; a key may hold dots."""
    return F.arrays_overlap(steps, F.array(*[F.lit(k) for k in PROTECTED_KEYS]))


def chunk_leaves(leaves: DataFrame, doc: str, order: str, size: int = LEAVES_PER_CHUNK) -> DataFrame:
    """Number leaves ``v0, v1, ...`` and put ``size`` of them in a chunk.

    ``order`` is the leaf's integer position in its document; numbering works in
    blocks, so one very long document does not end up in one task.
    """
    numbered = position_rank(leaves, doc, order).withColumn("n", F.col("rank") - 1).drop("rank")
    return numbered.select(
        "*", F.concat(F.lit("v"), F.col("n")).alias("leaf_id"), F.floor(F.col("n") / size).alias("chunk")
    )


def chunk_maps(chunked: DataFrame, doc: str) -> DataFrame:
    """One ``leaf_id -> value`` map per chunk, as sent to a translator."""
    return chunked.groupBy(doc, "chunk").agg(
        F.map_from_entries(F.collect_list(F.struct("leaf_id", "value"))).alias("mapping")
    )


def needs_retry(original: Column, got: Column) -> Column:
    """Nothing came back, or the text came back unchanged."""
    return F.coalesce((got == "") | (trimmed(got) == trimmed(original)), F.lit(True))


def translation_merge(leaves: DataFrame, memory: DataFrame) -> DataFrame:
    """Translated text where the memory has one, else the original; Latin digits.

    The memory is first reduced to one row per value.  The join key leads with a
    hash, so sorting and comparing long texts is rarely needed.
    """
    known = (
        memory.groupBy("value")
        .agg(F.min_by("translation", "memory_id").alias("translation"))
        .withColumn("value_hash", F.xxhash64("value"))
    )
    merged = leaves.withColumn("value_hash", F.xxhash64("value")).join(known, ["value_hash", "value"], "left")
    usable = F.coalesce(trimmed(F.col("translation")) != "", F.lit(False))
    return merged.drop("value_hash").select(
        *leaves.columns,
        usable.alias("translated"),
        needs_retry(F.col("value"), F.col("translation")).alias("retry"),
        latin_digits(F.when(usable, F.col("translation")).otherwise(F.col("value"))).alias("result"),
    )


def rebuild_rows(rows: DataFrame, merged: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Put translated leaves back into their columns; the rest stays as it was."""
    wide = merged.groupBy(*keys).agg(
        *[F.max(F.when(F.col("path") == f, F.col("result"))).alias(f"{f}_new") for f in fields]
    )
    joined = rows.join(wide, list(keys), "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"{c}_new"), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in rows.columns
        ]
    )


def label_translate(rows: DataFrame, labels: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Replace label columns found in the dictionary (a dozen rows, one map)."""
    dictionary = labels.agg(F.map_from_entries(F.collect_list(F.struct("label_en", "label_ar")))).scalar()
    return rows.withColumns({f: F.coalesce(F.try_element_at(dictionary, F.col(f)), F.col(f)) for f in fields})


def array_sizes(docs: DataFrame, doc: str, json_col: str) -> DataFrame:
    """Length of every array field of a payload; the top level counts as ``$``."""
    node = docs.select(doc, F.try_parse_json(json_col).alias("node"))
    is_array = F.schema_of_variant("node").startswith("ARRAY")
    fields = F.when(
        is_array, F.create_map(F.lit("$"), F.col("node"))
    ).otherwise(F.try_variant_get("node", "$", "map<string,variant>"))
    rows = node.select(doc, F.explode(fields).alias("field", "value"))
    return rows.filter(F.schema_of_variant("value").startswith("ARRAY")).select(
        doc, "field", F.size(F.try_variant_get("value", "$", "array<variant>")).alias("n")
    )


def translation_usable(original: DataFrame, translated: DataFrame, doc: str, json_col: str) -> DataFrame:
    """Usable when there is one and no non-empty list came back shorter."""
    want = array_sizes(original, doc, json_col).filter("n > 0")
    got = array_sizes(translated, doc, json_col).withColumnRenamed("n", "n_got")
    short = (
        want.join(got, [doc, "field"], "left")
        .groupBy(doc)
        .agg(F.bool_or(F.coalesce(F.col("n_got"), F.lit(-1)) < F.col("n")).alias("short"))
    )
    present = translated.select(doc, F.col(json_col).isNotNull().alias("present"))
    return (
        original.select(doc)
        .join(present, doc, "left")
        .join(short, doc, "left")
        .select(
            doc,
            (F.coalesce("present", F.lit(False)) & ~F.coalesce("short", F.lit(False))).alias("usable"),
        )
    )
