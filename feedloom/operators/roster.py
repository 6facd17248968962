"""Resolving commentator names against a curated roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import with_norm_name
from feedloom.session import cut_lineage, small_side

ANCHOR_CHARS = 3


def _substrings(text: str, size):
    """All substrings of ``text`` of ``size`` characters, as an array column."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.transform(starts, lambda i: F.substring(F.col(text), i, size))


def roster_hits(names: DataFrame, roster: DataFrame) -> DataFrame:
    """``(conflict, norm, ord)`` of the first roster row whose name contains the
    given name or is contained in it.

    Both directions are equi-joins.  A roster name is looked up inside a longer
    name by those of its characters in a row that the fewest roster names have,
    and then verified, so a common title in front makes no hot key; a short form
    such as a surname is looked up in the table of all pieces of the (curated)
    roster.
    """
    firsts = roster.groupBy("conflict", F.col("norm").alias("full")).agg(F.min("ord").alias("ord"))

    pieces = firsts.select(
        "conflict",
        "ord",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.when(F.length("full") > 0, F.sequence(F.lit(1), F.length("full"))),
                        lambda size: F.transform(
                            F.sequence(F.lit(1), F.length("full") - size + 1),
                            lambda i: F.substring(F.col("full"), i, size),
                        ),
                    )
                )
            )
        ).alias("norm"),
    )
    shorter = names.join(pieces.groupBy("conflict", "norm").agg(F.min("ord").alias("ord")), ["conflict", "norm"])

    anchored = _anchored(firsts)
    grams = names.select(
        "conflict",
        "norm",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array(F.lit("")),
                    *[
                        F.coalesce(_substrings("norm", F.lit(n)), F.array().cast("array<string>"))
                        for n in range(1, ANCHOR_CHARS + 1)
                    ],
                )
            )
        ).alias("anchor"),
    )
    longer = grams.join(anchored, ["conflict", "anchor"]).filter(F.contains("norm", "full"))

    columns = ("conflict", "norm", "ord")
    return shorter.select(*columns).unionByName(longer.select(*columns)).groupBy("conflict", "norm").agg(
        F.min("ord").alias("ord")
    )


def _anchored(firsts: DataFrame) -> DataFrame:
    """Roster names with their rarest ``ANCHOR_CHARS`` characters in a row; shorter names whole."""
    grams = F.array_distinct(F.coalesce(_substrings("full", F.lit(ANCHOR_CHARS)), F.array("full")))
    parts = firsts.select("conflict", "full", "ord", F.explode(grams).alias("anchor"))
    shared = parts.groupBy("conflict", "anchor").agg(F.count(F.lit(1)).alias("n"))
    return (
        parts.join(shared, ["conflict", "anchor"])
        .groupBy("conflict", "full", "ord")
        .agg(F.min(F.struct("n", "anchor")).alias("rarest"))
        .select("conflict", "full", "ord", "rarest.anchor")
    )


def roster_match(
    comments: DataFrame, roster: DataFrame, strip_marks: bool = False, min_len: int = 1
) -> DataFrame:
    """Keep comments by roster members, under their canonical name and title.

    Only distinct names are normalised and matched; the comments themselves are
    joined once, on the name as written.  Distinct names are stored before that:
    each use would read (and parse) the comments again, and filters on the
    normalised name would be pushed to every comment.
    """
    people = cut_lineage(roster.groupBy("conflict", "name").agg(F.min("ord").alias("ord")))
    named = with_norm_name(people, "name", strip_marks=strip_marks)
    written = cut_lineage(comments.select("conflict", "author").distinct())
    authors = with_norm_name(written, "author", strip_marks=strip_marks).filter(F.length("norm") >= min_len)
    hits = roster_hits(authors.select("conflict", "norm").distinct(), named.select("conflict", "norm", "ord"))
    resolved = (
        authors.join(hits, ["conflict", "norm"])
        .join(roster.select("conflict", "ord", "name", "title"), ["conflict", "ord"])
        .select("conflict", "author", F.col("name").alias("canonical"), F.col("title").alias("canonical_title"))
    )
    kept = [c for c in comments.columns if c not in ("author", "affiliation")]
    return comments.join(small_side(resolved, counted=written), ["conflict", "author"]).select(
        *kept, F.col("canonical").alias("author"), F.col("canonical_title").alias("affiliation")
    )
