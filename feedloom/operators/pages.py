"""Landed pages: visible text, truncation, and corpus assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import head, main_text, tail
from feedloom.session import small_side
from feedloom.sources.topics import CORPUS_STYLE


def load_pages(pages: DataFrame, n: int, mode: str = "head", text_col: str = "html") -> DataFrame:
    """Visible text cut to ``n`` characters from one end; pages without text go."""
    cut = head if mode == "head" else tail
    return (
        pages.withColumn("text", main_text(F.col(text_col)))
        .filter(F.length("text") > 0)
        .withColumn("text", cut(F.col("text"), n))
    )


def first_sources(sources: DataFrame, n: int | None, group: str = "conflict", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """First ``n`` sources of each topic, or all of them, with their rank.

    The rank filter becomes a per-partition limit before the shuffle, so a topic
    with very many sources ships ``n`` rows per input partition.
    """
    w = Window.partitionBy(group).orderBy(*order)
    ranked = sources.withColumn("rank", F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def assemble_corpus(texts: DataFrame, style: str, group: str = "conflict") -> DataFrame:
    """One text per topic from ``(group, rank, source, text)``.

    The caller bounds the input first (``first_sources`` plus ``load_pages``):
    a corpus is at most a few sources of a few thousand characters.
    """
    before, after, separator = CORPUS_STYLE[style]
    part = F.concat(F.lit(before), "source", F.lit(after), "text")
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return texts.groupBy(group).agg(
        F.array_join(F.transform(parts, lambda p: p["part"]), separator).alias("corpus"),
        F.count(F.lit(1)).alias("n_sources"),
    )


def position_rank(df: DataFrame, group: str, pos: str, block: int = 100_000) -> DataFrame:
    """Dense 1-based ``rank`` of each row in its group, for unique integer positions.

    Positions are cut into blocks; rows are numbered inside a block and shifted
    by the rows of earlier blocks.  No task holds more than one block of rows or
    one group's block counts, even if one group holds a third of the table.
    """
    blocks = df.withColumn("block", F.floor(F.col(pos) / block))
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy(group, "block")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(group, "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    inside = F.row_number().over(Window.partitionBy(group, "block").orderBy(pos))
    return (
        blocks.withColumn("inside", inside)
        .join(small_side(offsets), [group, "block"])
        .withColumn("rank", F.col("inside") + F.col("offset"))
        .drop("block", "inside", "offset")
    )


def split_halves(df: DataFrame, group: str = "conflict", pos: str = "pos") -> DataFrame:
    """Mark the first ceil(n/2) rows of each group as half 1, the rest as half 2."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    first = F.col("rank") <= F.ceil(F.col("n") / 2)
    return position_rank(df, group, pos).join(small_side(sizes), group).withColumn("half", F.when(first, 1).otherwise(2))
