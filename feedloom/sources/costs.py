"""Append-only cost log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("panel", "provider", "model", "units", "unit_type", "cost_usd", "cache_hit", "created_at")


def with_cost_defaults(rows: DataFrame) -> DataFrame:
    """Fill what a caller may leave out; a cache hit costs nothing."""
    have = set(rows.columns)

    def col(name: str, kind: str):
        return (F.col(name) if name in have else F.lit(None)).cast(kind)

    hit = F.coalesce(col("cache_hit", "boolean"), F.lit(False))
    return rows.select(
        *[c for c in rows.columns if c not in COLUMNS],
        "panel",
        "provider",
        col("model", "string").alias("model"),
        F.coalesce(col("units", "decimal(18,6)"), F.lit(1).cast("decimal(18,6)")).alias("units"),
        F.coalesce(col("unit_type", "string"), F.lit("request")).alias("unit_type"),
        F.when(hit, F.lit(0).cast("decimal(18,6)"))
        .otherwise(F.coalesce(col("cost_usd", "decimal(18,6)"), F.lit(0).cast("decimal(18,6)")))
        .alias("cost_usd"),
        hit.alias("cache_hit"),
        "created_at",
    )


def append_costs(rows: DataFrame, path: str) -> None:
    with_cost_defaults(rows).write.mode("append").parquet(path)


# What a column must be readable as.
KINDS = {"units": "decimal(18,6)", "cost_usd": "decimal(18,6)", "cache_hit": "boolean", "created_at": "timestamp"}


def judged_costs(rows: DataFrame) -> DataFrame:
    """Typed cost rows with ``reason``, the first thing wrong with a row, and ``received``, the row as JSON.

    Panel, provider and time must be there; numbers must be readable and not negative.
    """
    have = set(rows.columns)
    sent = {c: F.col(c).cast("string") if c in have else F.lit(None).cast("string") for c in COLUMNS}
    typed = {c: F.col(c).try_cast(KINDS[c]) if c in have else F.lit(None).cast(KINDS[c]) for c in KINDS}
    reason = F.lit(None).cast("string")
    for c in reversed(COLUMNS):
        if c in KINDS:
            reason = F.when(sent[c].isNotNull() & typed[c].isNull(), f"{c} is not a {KINDS[c]}").otherwise(reason)
        if c in ("units", "cost_usd"):
            reason = F.when(typed[c] < 0, f"{c} is negative").otherwise(reason)
        if c in ("panel", "provider", "created_at"):
            reason = F.when(F.trim(F.coalesce(sent[c], F.lit(""))) == "", f"{c} is missing").otherwise(reason)
    return rows.select(
        *[typed[c].alias(c) if c in KINDS else sent[c].alias(c) for c in COLUMNS],
        reason.alias("reason"),
        F.to_json(F.struct(*rows.columns)).alias("received"),
    )
