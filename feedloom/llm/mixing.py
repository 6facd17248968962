"""Mix sources to target weights by Poisson replication, with DataFrame functions only.

Each document of source s is repeated k times, k drawn from a Poisson
distribution whose mean is the repetition rate that brings the source to its
target share. The draw inverts the distribution at a uniform number taken from a
hash of seed and document, so it is the same in every run and on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 16  # a mean is split into terms of at most STEP, so exp(-mean) keeps its digits
TERMS = 80  # P(k > TERMS) is under 1e-28 at mean STEP: the sum has reached 1 in doubles
HEX = 13  # 52 bits, exact in a double


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of ``parts``."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, HEX), 16, 10).cast("double") / F.lit(float(16**HEX))


def poisson_steps(mean: Column) -> Column:
    """``[P(k <= 0), P(k <= 1), ...]`` of a Poisson variable, summed in this order."""
    begin = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("steps")
    )

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["steps"], F.array(s["c"] + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), begin, add, lambda s: s["steps"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """``source, rate``: the mean number of copies of each source's documents.

    ``weights`` (``source, weight``) gives target shares of characters; sources it
    does not name get none. Without it a source's share is its characters to the
    power ``temperature``. The expected volume is ``budget`` times the input. The
    table has one row for each source; a null source is one of them.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length("text")).cast("double").alias("chars"))
    if weights is None:
        goal = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.pow("chars", F.lit(temperature))).otherwise(0.0))
    else:
        named = weights.groupBy("source").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        goal = (
            sizes.join(named.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "left")
            .withColumn("weight", F.when(F.col("chars") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
        )
    total = goal.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    rate = F.lit(budget * (total["chars"] or 0.0)) * F.col("weight") / F.lit(total["weight"] or 1.0) / F.col("chars")
    return goal.select("source", F.when(F.col("weight") > 0, rate).otherwise(0.0).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = 0.5,
    budget: float = 1.0,
    seed: int = 7,
    small: int = 10_000,
    number: str = "copy",
) -> DataFrame:
    """All columns of ``docs`` and the copy's ``number`` (from 0), each row as often as its draw says, shuffled globally.

    The shuffle deals rows by a hash of (seed, document, copy) and sorts each
    partition by it, so the order has nothing to do with the source or the input.
    Up to ``small`` sources (they are counted) the table of rates is broadcast;
    beyond that it is joined by source, and AQE splits a hot one.

    Nulls: a null source is a source of its own; a null text has no characters and
    follows its source's rate; a source without characters gets no copies. Rows
    that share a doc_id share their draw; a null doc_id is replaced by the text's
    hash. An empty table gives no rows. A column with the name of ``number`` is
    replaced; other extra columns are kept (but for names that begin with ``__``).
    """
    rates = source_rates(docs, weights, temperature, budget).where(F.col("rate") > 0)
    terms = F.ceil(F.col("rate") / STEP).cast("int")
    rates = rates.select(
        F.col("source").alias("__source"), terms.alias("__terms"), poisson_steps(F.col("rate") / terms).alias("__steps")
    )
    if rates.limit(small + 1).count() <= small:
        rates = F.broadcast(rates)
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("__terms")),
        F.lit(0),
        lambda n, i: n + F.size(F.filter("__steps", lambda c: c <= uniform(F.lit(seed), i.cast("string"), F.col("__who")))),
    )
    kept = [c for c in docs.columns if c != number]
    copies = (
        docs.select(*kept)
        .join(rates, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__who", who)
        .withColumn("__copies", draw)
        .where(F.col("__copies") > 0)
        .select(*kept, "__who", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("__copy"))
        .withColumn("__at", F.xxhash64(F.lit(seed), "__who", "__copy"))
    )
    return copies.repartition("__at").sortWithinPartitions("__at").select(*kept, F.col("__copy").alias(number))
