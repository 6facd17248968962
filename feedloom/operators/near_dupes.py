"""Greedy near-duplicate headline removal, exact and without all-pairs work.

Reading a topic's items in order, an item is kept unless it shares at least
``min_shared`` title words with an item kept before it.  One long loop becomes a
few rounds over all topics at once:

1. Equal word sets collapse to their first item (copies cost one aggregate).
2. A block, the first undecided word sets of a topic, is settled in order by one
   task.  Its size is bounded, whatever the topic holds.
3. The block's kept titles go to every slice of the topic's other undecided sets,
   where an inverted index of their words finds what they repeat.  Only kept titles
   are ever compared with, and no pairs leave a task: a template shared by millions
   of titles is gone after the round that keeps its first.
4. What is left is stored in the shared folder and the next round begins.

Blocks follow each other in order, so the first round that drops an item also names
the first kept item it repeats.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import title_words
from feedloom.session import cut_lineage, scratch_path, small_side, stored

MIN_SHARED = 4
# Titles in a slice of a topic, at least.
MAX_POSTING = 128
# Words of undecided titles that one task settles in one go, at WORDS a title: a block of SLICES slices.
LAST_ROWS = 500_000
WORDS = 16
SLICES = 4
# Titles of a block that are compared with each other, and counters held at a time.
STEP = 512
CELLS = 1 << 21


def _encoded(*titles: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and lengths of each column of titles, under one numbering from zero."""
    lists = [pc.split_pattern(pa.concat_arrays(t.chunks) if t.num_chunks else pa.array([], pa.string()), " ") for t in titles]
    lengths = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    flat = pa.concat_arrays([x.flatten() for x in lists])
    numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    return list(zip(np.split(numbers, np.cumsum([n.sum() for n in lengths])[:-1]), lengths))


def _taken(words: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The titles at ``rows``."""
    some = lengths[rows]
    begins = (np.cumsum(lengths) - lengths)[rows]
    return words[np.repeat(begins - (np.cumsum(some) - some), some) + np.arange(some.sum())], some


class _Postings:
    """Titles by word."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, vocabulary: int):
        self.size = len(lengths)
        self.owners = np.repeat(np.arange(self.size), lengths)[np.argsort(words, kind="stable")]
        self.held = np.bincount(words, minlength=vocabulary)
        self.begins = np.cumsum(self.held) - self.held

    def shared(self, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """First row and number of words that each row shares with each title, some rows at a time."""
        ends = np.concatenate([[0], np.cumsum(lengths)])
        reach = np.concatenate([[0], np.cumsum(self.held[words])])[ends]
        row = 0
        while row < len(lengths):
            stop = min(row + max(1, CELLS // self.size), int(np.searchsorted(reach, reach[row] + CELLS, "right")) - 1, len(lengths))
            stop = max(stop, row + 1)
            some = words[ends[row] : ends[stop]]
            held = self.held[some]
            at = np.repeat(self.begins[some] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            own = np.repeat(np.repeat(np.arange(stop - row) * self.size, lengths[row:stop]), held)
            yield row, np.bincount(own + self.owners[at], minlength=(stop - row) * self.size).reshape(-1, self.size)
            row = stop

    def first(self, words: np.ndarray, lengths: np.ndarray, min_shared: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the first title that shares enough words, -1 if none does, and how many it shares."""
        found, counts = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64)
        for row, shared in self.shared(words, lengths):
            enough = shared >= min_shared
            title = enough.argmax(axis=1)
            each = np.arange(len(shared))
            hit = enough[each, title]
            found[row : row + len(shared)] = np.where(hit, title, -1)
            counts[row : row + len(shared)] = shared[each, title]
        return found, counts


def _settle_block(block: pa.Table, min_shared: int) -> pa.Table:
    """Every title of a block with the first kept one it repeats, kept ones with themselves and their words."""
    block = block.sort_by("oid")
    words, lengths = _encoded(block.column("words"))[0]
    vocabulary = int(words.max()) + 1
    by, shared = np.full(len(lengths), -1), lengths.copy()
    kept = np.empty(0, np.int64)
    for at in range(0, len(lengths), STEP):
        rows = np.arange(at, min(at + STEP, len(lengths)))
        if len(kept):
            index = _Postings(*_taken(words, lengths, kept), vocabulary)
            found, counts = index.first(*_taken(words, lengths, rows), min_shared)
            hit = found >= 0
            by[rows[hit]], shared[rows[hit]] = kept[found[hit]], counts[hit]
            rows = rows[~hit]
        if not len(rows):
            continue
        own = _taken(words, lengths, rows)
        for row, counts in _Postings(*own, vocabulary).shared(*own):
            for i, each in enumerate(counts, row):
                if by[rows[i]] < 0:
                    by[rows[i]] = rows[i]
                    later = i + 1 + np.flatnonzero(each[i + 1 :] >= min_shared)
                    later = later[by[rows[later]] < 0]
                    by[rows[later]], shared[rows[later]] = rows[i], each[later]
        kept = np.concatenate([kept, rows[by[rows] == rows]])
    oid = block.column("oid").to_numpy()
    own = np.arange(len(by))
    heads = block.column("words").take(pa.array(own, mask=by != own))
    return pa.table([block.column("conflict"), pa.array(oid), heads, pa.array(oid[by]), pa.array(shared)], names=_COLUMNS)


def _drop_repeats(rest: pa.Table, heads: pa.Table, min_shared: int) -> pa.Table:
    """Undecided titles with the first of the new kept ones they repeat, null if none."""
    heads = heads.sort_by("oid")
    (words, lengths), (own, sizes) = _encoded(heads.column("words"), rest.column("words"))
    index = _Postings(words, lengths, int(max(words.max(initial=0), own.max(initial=0))) + 1)
    found, counts = index.first(own, sizes, min_shared)
    miss = found < 0
    by = pa.array(heads.column("oid").to_numpy()[found], mask=miss)
    left = rest.column("words").take(pa.array(np.arange(len(miss)), mask=~miss))
    return pa.table([rest.column("conflict"), rest.column("oid"), left, by, pa.array(counts, mask=miss)], names=_COLUMNS)


_COLUMNS = ["conflict", "oid", "words", "kept_oid", "shared"]


class TitleGroups:
    """Settled near-duplicate groups of one item table.

    ``reps`` has one row per distinct word set (``oid`` follows item order, ``words``
    are joined by spaces), ``members`` names for each the first kept one it repeats,
    itself if it is kept, and the number of words they share.
    """

    def __init__(
        self,
        items: DataFrame,
        min_shared: int = MIN_SHARED,
        max_posting: int = MAX_POSTING,
        last_rows: int = LAST_ROWS,
    ):
        self.min_shared = min_shared
        self.slice = max(max_posting, last_rows // WORDS // SLICES, 1)
        # Unnesting a one-element array keeps the size filters below from being
        # pushed under the word splitting, which would then run twice per title.
        self.sets = items.select(
            "conflict",
            "pos",
            F.coalesce("ts_raw", F.lit("")).alias("ts_raw"),
            F.explode(F.array(F.array_sort(title_words(F.col("title"))))).alias("words"),
        ).select("conflict", "pos", "ts_raw", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))
        self.reps = self._representatives()
        self.members = self._settle()

    # -- results ---------------------------------------------------------------

    def survivors(self) -> DataFrame:
        """``(conflict, pos)`` of the kept items that have enough words to repeat."""
        lost = self.members.filter("kept_oid <> oid").select("oid")
        return self.reps.join(lost, "oid", "left_anti").select("conflict", "pos")

    def kept_positions(self) -> DataFrame:
        """``(conflict, pos)`` of every kept item."""
        short = self.sets.filter(F.col("n") < self.min_shared).select("conflict", "pos")
        return self.survivors().unionByName(short)

    def absorbed(self) -> DataFrame:
        """Each dropped item with the first kept item it repeats and the number
        of title words they share.  One row per dropped item."""
        winner = self.reps.select(F.col("oid").alias("kept_oid"), F.col("pos").alias("kept_pos"))
        verdict = self.members.join(winner, "kept_oid").join(self.reps.select("oid", "conflict", "words"), "oid")
        return (
            self.sets.filter(F.col("n") >= self.min_shared)
            .join(verdict.select("conflict", "words", "kept_pos", "shared"), ["conflict", "words"])
            .filter(F.col("pos") != F.col("kept_pos"))
            .select("conflict", "pos", "kept_pos", F.col("shared").cast("int").alias("shared"))
        )

    # -- steps -----------------------------------------------------------------

    def _representatives(self) -> DataFrame:
        firsts = (
            self.sets.filter(F.col("n") >= self.min_shared)
            .groupBy("conflict", "words")
            .agg(F.min(F.struct("ts_raw", "pos")).alias("first"))
            .select("conflict", "words", "first.ts_raw", "first.pos")
        )
        # Sorted by range partition, so the generated id rises with the order;
        # the checkpoint pins it.
        ordered = firsts.orderBy("conflict", "ts_raw", "pos")
        return cut_lineage(
            ordered.select(F.monotonically_increasing_id().alias("oid"), "conflict", "pos", "words")
        )

    def _settle(self) -> DataFrame:
        """``oid, kept_oid, shared`` of every representative that has a topic.

        A round settles the next block of each topic and drops what its kept titles
        repeat from the rest; each block keeps its first title, so rounds end.
        """
        spark, min_shared = self.reps.sparkSession, self.min_shared
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        columns = f"conflict {self.reps.schema['conflict'].dataType.simpleString()}, oid long, words string, kept_oid long, shared long"
        rest = self.reps.filter(F.col("conflict").isNotNull()).select(
            "conflict", F.floor(F.col("oid") / self.slice).alias("slice"), "oid", "words"
        )
        path, steps = scratch_path(spark, "titles"), itertools.count()
        while True:
            # Contiguous ids: a block is the leading slices of its topic, at least one of them.
            slices = rest.groupBy("conflict", "slice").agg(F.count(F.lit(1)).alias("n"))
            before = Window.partitionBy("conflict").orderBy("slice")
            place = slices.select(
                "conflict", "slice", ((F.row_number().over(before) == 1) | (F.sum("n").over(before) <= SLICES * self.slice)).alias("next")
            )
            place = cut_lineage(place)
            first = place.filter("next").select("conflict", "slice")
            block = rest.join(small_side(first), ["conflict", "slice"]).select("conflict", "oid", "words")
            # By number, so that small topics are not put into one task.
            block = block.repartition(tasks, "conflict").groupBy("conflict")
            done = stored(block.applyInArrow(lambda t: _settle_block(t, min_shared), columns), f"{path}/step={next(steps)}")
            later = place.filter("not next").select("conflict", "slice")
            if later.isEmpty():
                break
            heads = done.filter("words is not null").select("conflict", "oid", "words").join(small_side(later.withColumnRenamed("slice", "part")), "conflict")
            left = rest.join(small_side(later), ["conflict", "slice"])
            met = (
                left.repartition(tasks, "conflict", "slice").groupBy("conflict", "slice")
                .cogroup(heads.repartition(tasks, "conflict", "part").groupBy("conflict", "part"))
                .applyInArrow(lambda a, b: _drop_repeats(a, b, min_shared), columns)
            )
            met = stored(met, f"{path}/step={next(steps)}").filter("kept_oid is null")
            rest = met.select("conflict", F.floor(F.col("oid") / self.slice).alias("slice"), "oid", "words")
            if rest.isEmpty():
                break
        return spark.read.schema(columns).parquet(path).filter("kept_oid is not null").select("oid", "kept_oid", "shared")


def dedupe_titles(items: DataFrame, **options) -> DataFrame:
    """Items that survive greedy headline de-duplication."""
    groups = TitleGroups(items, **options)
    survivors = groups.survivors().withColumn("survives", F.lit(True))
    # Too few words to repeat anything: decided on the row itself, before titles go through a shuffle.
    short = F.size(title_words(F.col("title"))) < groups.min_shared
    return (
        items.withColumn("short", short)
        .join(survivors, ["conflict", "pos"], "left")
        .filter(F.col("survives") | F.col("short"))
        .drop("survives", "short")
    )


def title_pairs(items: DataFrame, **options) -> DataFrame:
    """Which kept headline each dropped headline repeats."""
    return TitleGroups(items, **options).absorbed()
