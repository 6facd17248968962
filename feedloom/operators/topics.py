"""Topic dimension: the derived "all" topic, roster text, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.session import small_side
from feedloom.sources.topics import ALL, ALL_LABELS


def derive_all_config(config: DataFrame) -> DataFrame:
    """One row standing for every topic: joined terms, earliest start."""
    return config.agg(
        F.expr("listagg(search_terms, '; ') WITHIN GROUP (ORDER BY ord)").alias("search_terms"),
        F.min("start_date").alias("start_date"),
        F.count(F.lit(1)).alias("n_topics"),
    ).select(F.lit(ALL).alias("conflict"), *[F.lit(v).alias(k) for k, v in ALL_LABELS.items()], "*")


def derive_all_sources(sources: DataFrame, config: DataFrame) -> DataFrame:
    """Distinct sources over all topics with their first position.

    Kept as rows: ``first_ord, first_pos`` give the order without numbering the
    whole list in one place.
    """
    return (
        sources.join(config.select("conflict", "ord"), "conflict")
        .groupBy("url")
        .agg(F.min(F.struct("ord", "pos")).alias("first"))
        .select(F.lit(ALL).alias("conflict"), "url", F.col("first.ord").alias("first_ord"), F.col("first.pos").alias("first_pos"))
    )


def derive_all_roster(roster: DataFrame) -> DataFrame:
    """All rosters one after the other; no de-duplication."""
    return roster.withColumn("conflict", F.lit(ALL))


def roster_section(roster: DataFrame) -> DataFrame:
    """Heading and ``- Name (Title)`` lines per topic and kind."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "title", F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    heading = F.when(F.col("kind") == "official", "OFFICIALS").otherwise("EXPERT ANALYSTS")
    return roster.groupBy("conflict", "kind").agg(
        F.array_join(F.transform(lines, lambda e: e["line"]), "\n").alias("lines")
    ).select("conflict", "kind", F.concat(heading, F.lit(":\n"), "lines").alias("section"))


def padded_words(text: Column) -> Column:
    """Lower-case words separated and surrounded by single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def relevance(items: DataFrame, config: DataFrame, text: str) -> DataFrame:
    """Number of the topic's search terms that occur in the text as whole words.

    Terms travel as an array on the topic row, which is broadcast while the topics
    are few, so each text is read once where it lies: no explosion into words and
    no shuffle of texts.
    """
    terms = F.array_distinct(
        F.filter(
            F.transform(F.split("search_terms", ","), padded_words), lambda t: F.length(F.trim(t)) > 0
        )
    )
    dim = config.select("conflict", terms.alias("terms"))
    padded = items.withColumn("padded", padded_words(F.col(text)))
    hits = F.filter("terms", lambda t: F.contains(F.col("padded"), t))
    return padded.join(small_side(dim), "conflict").withColumn("n_terms", F.size(hits)).drop("terms", "padded")
