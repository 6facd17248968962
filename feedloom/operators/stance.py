"""Narrative stance: parsing responses, counting stories, spectrum shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.json_values import coerce_num, coerce_str
from feedloom.functions.text import clean_summary
from feedloom.sources.topics import TOPICS

COUNTS = ("left_count", "center_count", "right_count")
SHARES = ("left_pct", "center_pct", "right_pct")
STORIES = ("top_left_story", "top_center_story", "top_right_story")
DEFAULT_TOTAL_STORIES = 20


def parse_stance(responses: DataFrame, value: str, now_iso: str) -> DataFrame:
    """Typed stance fields from a recovered VARIANT column."""
    v = F.col(value)
    return responses.select(
        *[c for c in responses.columns if c != value],
        coerce_num(v, "$.total_stories", DEFAULT_TOTAL_STORIES).alias("total_stories"),
        *[coerce_num(v, f"$.{name}").alias(name) for name in COUNTS + SHARES],
        coerce_str(v, "$.summary").alias("summary"),
        *[coerce_str(v, f"$.{name}").alias(name) for name in STORIES],
        coerce_str(v, "$.last_updated", now_iso).alias("last_updated"),
    )


def with_clean_summary(stance: DataFrame) -> DataFrame:
    """Cleaning never empties a summary, so it can wait until rows are filtered."""
    return stance.withColumn("summary", clean_summary(F.col("summary")))


def has_content(stance: DataFrame) -> DataFrame:
    return stance.filter((F.col("summary") != "") & (sum(F.col(c) for c in COUNTS) > 0))


def stance_summary(stories: DataFrame, group: str = "conflict") -> DataFrame:
    """Counts, shares and one headline per stance, from labelled stories.

    ``stories`` has ``stance, strength, pos, title``; the strongest story of a
    stance represents it, the earliest among equals.
    """

    def is_(side: str) -> Column:
        return F.col("stance") == side

    def pick(side: str) -> Column:
        return F.max_by("title", F.when(is_(side), F.struct("strength", -F.col("pos"))))

    counted = stories.filter(F.col("stance").isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("total_stories"),
        *[F.count_if(is_(s)).alias(f"{s}_count") for s in ("left", "center", "right")],
        *[pick(s).alias(f"top_{s}_story") for s in ("left", "center", "right")],
    )
    for side in ("left", "center", "right"):
        counted = counted.withColumn(f"{side}_pct", F.col(f"{side}_count") * 100 / F.col("total_stories"))
    return counted


def stance_response(records: DataFrame, group: str, now_iso: str, topics: int = len(TOPICS)) -> DataFrame:
    """The answer of each run over all topics: how it went, and when.

    ``records`` are the runs' stance records, those without content included. A run
    whose every topic failed has no answer and no time; the others answer with the
    topics that have content.
    """
    good = has_content(records).groupBy(group).agg(F.count(F.lit(1)).alias("n_topics"))
    runs = records.select(group).distinct().join(good, group, "left").withColumn("n_topics", F.coalesce("n_topics", F.lit(0)))
    answered = F.col("n_topics") > 0
    return runs.select(
        group,
        F.when(~answered, "failed").when(F.col("n_topics") < topics, "partial").otherwise("complete").alias("status"),
        "n_topics",
        F.when(answered, F.lit(now_iso)).alias("last_updated"),
    )


def half_up(x: Column) -> Column:
    """Round half towards plus infinity, also for negative numbers."""
    return F.floor(x + 0.5)


def spectrum(stance: DataFrame) -> DataFrame:
    """Bar shares that add up to 100 even if the supplied percentages do not."""
    total = F.greatest(sum(F.col(c) for c in SHARES), F.lit(0.0001))
    shares = {c.replace("pct", "share"): F.col(c) / total * 100 for c in SHARES}
    shown = {c.replace("pct", "shown"): half_up(F.col(c)) for c in SHARES}
    return stance.withColumns({**shares, **shown})
