"""Cost roll-ups.  Money stays DECIMAL until the last cast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.session import small_side


def _total() -> list:
    zero = F.lit(0).cast("decimal(18,6)")
    return [F.coalesce(F.sum("cost_usd"), zero).cast("double").alias("total_cost_usd")]


def cost_summary(log: DataFrame) -> DataFrame:
    """Calls, hits, misses and cost per panel and provider, dearest first."""
    return (
        log.groupBy("panel", "provider")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col("cache_hit")).alias("cache_hits"),
            F.count_if(~F.col("cache_hit")).alias("cache_misses"),
            *_total(),
        )
        .orderBy(F.col("total_cost_usd").desc())
    )


def cost_totals(log: DataFrame) -> DataFrame:
    """Grand totals; one row even for an empty log."""
    return log.agg(F.count(F.lit(1)).alias("calls"), *_total())


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call from the price list.

    A model that the list does not know keeps the ``cost_usd`` it was logged with,
    or null where there is none: unknown is not free.
    """
    logged = F.col("cost_usd") if "cost_usd" in calls.columns else F.lit(None)
    cost = F.coalesce(F.col("units") * F.col("unit_price"), logged).cast("decimal(18,6)")
    return calls.join(small_side(prices), ["provider", "model"], "left").withColumn("cost_usd", cost).drop("unit_price")
