"""Source divergence audit: how far each source's use of words is from others and from its language.

A language's vocabulary is kept as minimal acyclic transducers that number its terms
lexicographically. Terms are range-partitioned, so that each transducer is built in
one task from its own sorted range and has a bounded size; ordinals go on from range
to range. Texts are then streamed through the transducers and counted by ordinal. A
pass ships transducers of a bounded number of edges; a vocabulary beyond that takes
further passes over the texts of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.storage import stored
from feedloom.llm.text_arrays import TO_LOWER, blocks
from feedloom.llm.transducer import Builder, Walker, prefix_key, words_of

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
SHARD_TERMS = 1 << 17  # of a transducer
PASS_EDGES = 1 << 21  # of the transducers that a task holds at a time: some 130 MB with their hash table
BATCH_BYTES = 1 << 22  # of texts that are counted together
SIDE = 256  # sources whose distances to all others are summed up together
CELLS = 1 << 22  # sums that a task holds before it hands them on

IN_TERM = np.ones(256, bool)
IN_TERM[:128] = [chr(b).isalpha() for b in range(128)]

SHARDS = "lang string, part int, seq int, prefix decimal(20,0), n_terms long, n_edges long, transducer binary"


def term_ranges(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start, end and document of every run of letters or characters beyond ASCII."""
    low = TO_LOWER[block.data]
    inside = IN_TERM[low]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return low, none, none, none
    edge = np.zeros(len(low) + 1, bool)
    edge[block.offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return low, starts, np.flatnonzero(ends) + 1, block.owner(starts)


def gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Longer batches, of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _labels(column: pa.Array) -> tuple[np.ndarray, list]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, term, n``: documents that hold each term, summed up over a batch."""
    for batch in gathered(batches):
        lang_of, langs = _labels(batch.column("lang"))
        for block in blocks(batch.column("text"), BATCH_BYTES):
            low, starts, ends, owner = term_ranges(block)
            if not len(starts):
                continue
            flat = np.ascontiguousarray(low[IN_TERM[low]])
            offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            coded = terms.dictionary_encode()
            n = len(coded.dictionary)
            held = np.unique(owner * n + coded.indices.to_numpy())
            keys, counts = np.unique(lang_of[block.first + held // n] * n + held % n, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()).take(pa.array(keys // n)),
                    coded.dictionary.take(pa.array(keys % n)).cast(pa.binary()).cast(pa.string()),
                    pa.array(counts),
                ],
                names=["lang", "term", "n"],
            )


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One transducer for each language and ``SHARD_TERMS`` of a sorted range."""
    part, seq = TaskContext.get().partitionId(), 0
    builder, lang, prefix = Builder(), None, 0

    def shard() -> pa.RecordBatch:
        data = builder.finish()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.decimal128(20, 0), pa.int64(), pa.int64(), pa.binary()]
        cells = [lang, part, seq, prefix, builder.n, builder.n_edges, data]
        return pa.RecordBatch.from_arrays(
            [pa.array([c], k) for c, k in zip(cells, kinds)],
            names=["lang", "part", "seq", "prefix", "n_terms", "n_edges", "transducer"],
        )

    for batch in batches:
        for own, term in zip(batch.column("lang").to_pylist(), batch.column("term").cast(pa.binary()).to_pylist()):
            if builder.n and (own != lang or builder.n >= SHARD_TERMS):
                yield shard()
                builder, seq = Builder(), seq + 1
            if not builder.n:
                lang, prefix = own, prefix_key(term)
            builder.add(term)
    if builder.n:
        yield shard()


class Vocabulary:
    """The stored transducers and their directory: one entry a shard, which is all the driver holds."""

    def __init__(self, shards: DataFrame):
        self.shards = shards
        rows = shards.drop("transducer").orderBy("part", "seq").collect()
        self.size: dict[str, int] = {}
        self.base: dict[tuple[int, int], int] = {}
        self.passes: list[list] = []
        edges = PASS_EDGES
        for r in rows:
            self.base[r["part"], r["seq"]] = self.size.get(r["lang"], 0)
            self.size[r["lang"]] = self.size.get(r["lang"], 0) + r["n_terms"]
            if edges + r["n_edges"] > PASS_EDGES or not self.passes:
                self.passes.append([])
                edges = 0
            self.passes[-1].append(r)
            edges += r["n_edges"]

    def transducers(self, rows: list, lang_ids: dict[str, int]) -> list[tuple[int, int, int, bytes]]:
        """The transducers of one pass; their edges are bounded by ``PASS_EDGES``, one shard at least."""
        first, last = rows[0], rows[-1]
        data = {
            (r["part"], r["seq"]): r["transducer"]
            for r in self.shards.where(
                F.struct("part", "seq").between(
                    F.struct(F.lit(first["part"]).alias("part"), F.lit(first["seq"]).alias("seq")),
                    F.struct(F.lit(last["part"]).alias("part"), F.lit(last["seq"]).alias("seq")),
                )
            ).collect()
        }
        return [
            (lang_ids[r["lang"]], int(r["prefix"]), self.base[r["part"], r["seq"]], bytes(data[r["part"], r["seq"]]))
            for r in rows
        ]

    def terms(self) -> DataFrame:
        """``lang, ordinal, term``: the words of the transducers."""
        base = self.base

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    first, words = base[r["part"], r["seq"]], []
                    for n, word in enumerate(words_of(r["transducer"]), 1):
                        words.append(word)
                        if len(words) == 1 << 14 or n == r["n_terms"]:
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([r["lang"]] * len(words), pa.string()),
                                    pa.array(np.arange(first + n - len(words), first + n)),
                                    pa.array(words, pa.binary()).cast(pa.string()),
                                ],
                                names=["lang", "ordinal", "term"],
                            )
                            words = []

        return self.shards.select("lang", "part", "seq", "n_terms", "transducer").mapInArrow(run, "lang string, ordinal long, term string")


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> Vocabulary:
    """Terms of each ``lang`` in at least ``min_docs`` of its rows, as transducers."""
    counted = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    kept = stored(kept.select("lang", "term"), "terms")
    ranges = max(1, -(-kept.count() // SHARD_TERMS))
    kept = kept.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
    return Vocabulary(stored(kept.mapInArrow(_build_shards, SHARDS), "transducers"))


def _recount(parts, groups: dict[tuple[str, str], int], lang_ids: dict[str, int]):
    """``g, ordinal, n``: occurrences of the terms in the texts of each group, summed up over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(parts.value)
        for batch in gathered(batches):
            lang_of, langs = _labels(batch.column("lang"))
            source_of, sources = _labels(batch.column("source"))
            pairs, pair_of = np.unique(lang_of * len(sources) + source_of, return_inverse=True)
            group_of = np.array([groups[langs[p // len(sources)], sources[p % len(sources)]] for p in pairs.tolist()], np.int64)[pair_of]
            for block in blocks(batch.column("text"), BATCH_BYTES):
                low, starts, ends, owner = term_ranges(block)
                own = owner + block.first
                keys = []
                for k, lang in enumerate(langs):
                    some = np.flatnonzero(lang_of[own] == k)
                    at = walker.ordinals(low, starts[some], ends[some], lang_ids[lang])
                    kept = at >= 0
                    keys.append((group_of[own[some[kept]]] << 40) + at[kept])
                found, n = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((found >> 40).astype(np.int32)), pa.array(found & ((1 << 40) - 1)), pa.array(n)],
                    names=["g", "ordinal", "n"],
                )

    return run


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly, by division in three steps."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def _prune(g: np.ndarray, ordinal: np.ndarray, value: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ordinal, -value, g))
    g, ordinal, value = g[order], ordinal[order], value[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    some = rank < top
    return g[some], ordinal[some], value[some]


def _divergence_rows(spans: dict[int, tuple[int, int]], totals: np.ndarray, sizes: dict[int, int], top: int):
    """Sums of the terms of a task for each pair of groups, and its best terms of each group.

    Rows: language, side (a range of its sources), ordinal, and the groups that hold
    the term with their counts.
    """
    scores = "kind", "g", "other", "value"

    def rows(kind: int, g, other, value) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(g), kind, np.int32)), pa.array(g.astype(np.int32)), pa.array(other), pa.array(value)], names=list(scores)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        best = [np.zeros(0, np.int64)] * 3

        def emit():
            for (lang, side), square in sums.items():
                low = spans[lang][0]
                i, j = np.indices(square.shape)
                yield rows(0, (i + low + side * SIDE).ravel(), (j + low).ravel(), square.ravel())
            sums.clear()

        for batch in batches:
            langs, sides = batch.column("l").to_numpy(), batch.column("side").to_numpy()
            ordinals, held = batch.column("ordinal").to_numpy(), batch.column("held")
            ends = held.offsets.to_numpy()
            cells = held.values.slice(0)
            group, count = cells.field("g").to_numpy(), cells.field("n").to_numpy()
            for lang, side in sorted(set(zip(langs.tolist(), sides.tolist()))):
                low, high = spans[lang]
                mine = np.flatnonzero((langs == lang) & (sides == side))
                step = max(1, CELLS // (high - low))
                for k in range(0, len(mine), step):
                    some = mine[k : k + step]
                    n = ends[some + 1] - ends[some]
                    row = np.repeat(np.arange(len(some)), n)
                    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[some], n)
                    counts = np.zeros((len(some), high - low), np.int64)
                    counts[row, group[at] - low] = count[at]
                    p = shares(counts, totals[low:high] + sizes[lang])
                    here = range(side * SIDE, min((side + 1) * SIDE, high - low))
                    if (lang, side) not in sums:
                        if sum(s.size for s in sums.values()) + len(here) * (high - low) > CELLS:
                            yield from emit()
                        sums[lang, side] = np.zeros((len(here), high - low), np.int64)
                    square = sums[lang, side]
                    for i in here:
                        apart = p[:, i, None] - p
                        square[i - side * SIDE] += (apart * apart // p).sum(0)
                    if side == 0:
                        q = shares(counts.sum(1), totals[low:high].sum() + sizes[lang])[:, None]
                        r, c = np.nonzero((counts > 0) & (p > q))
                        apart = p[r, c] - q[r, 0]
                        new = c + low, ordinals[some][r], apart * apart // q[r, 0]
                        best = [np.concatenate(x) for x in zip(best, new)]
                        if len(best[0]) > 1 << 18:
                            best = list(_prune(*best, top))
                            if len(best[0]) > 1 << 17:  # very many groups: hand them on
                                yield rows(1, *best)
                                best = [np.zeros(0, np.int64)] * 3
        yield from emit()
        yield rows(1, *_prune(*best, top))

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group.

    Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z in lower
    case; a language keeps those in at least ``min_docs`` of its rows. Part ``pair``
    ranks all other sources of the language by divergence, part ``term`` the ``top``
    terms that a source uses more than its language does. Ties go to the smaller
    item in UTF-8.

    Nulls: a null text, lang or source is read as ''. Groups without terms still take
    part; where a language keeps no term, all pairs have value 0. Repeated rows count
    as often as they occur. An empty table gives no rows. Other columns are ignored.

    The driver holds the list of groups, whose square the result holds, one entry for
    each transducer, and a pass's transducers. A term of n bytes takes up to n states
    of its transducer, some 300 bytes each while it is built.
    """
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    names = sorted(map(tuple, rows.select("lang", "source").distinct().collect()))
    groups = {pair: g for g, pair in enumerate(names)}
    lang_ids: dict[str, int] = {}
    spans: dict[int, tuple[int, int]] = {}
    for g, (lang, _) in enumerate(names):
        own = lang_ids.setdefault(lang, len(lang_ids))
        spans[own] = (spans.get(own, (g,))[0], g + 1)
    kept = vocabulary(rows, min_docs)
    sizes = {lang_ids[lang]: n for lang, n in kept.size.items()}

    schema = "g int, ordinal long, n long"
    counted = [spark.createDataFrame([], schema)]
    sent = []
    for shards in kept.passes:
        parts = spark.sparkContext.broadcast(kept.transducers(shards, lang_ids))
        sent.append(parts)
        own = rows.where(F.col("lang").isin(sorted({r["lang"] for r in shards})))
        counted.append(stored(own.mapInArrow(_recount(parts, groups, lang_ids), schema).groupBy("g", "ordinal").agg(F.sum("n").alias("n")), "recount"))
        parts.unpersist()
    counts = counted[0]
    for one in counted[1:]:
        counts = counts.unionByName(one)
    totals = np.zeros(len(names), np.int64)
    for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect():
        totals[r["g"]] = r["n"]

    known = spark.createDataFrame(
        [(g, lang_ids[lang], lang, source, sizes.get(lang_ids[lang], 0)) for g, (lang, source) in enumerate(names)],
        "g int, l int, lang string, source string, size long",
    )
    sides = known.groupBy("l").agg((F.ceil(F.count("*") / SIDE) - 1).cast("int").alias("last"))
    held = (
        counts.join(known.select("g", "l"), "g")
        .groupBy("l", "ordinal")
        .agg(F.collect_list(F.struct("g", "n")).alias("held"))  # as many as the language has sources
        .join(sides, "l")
        .select("l", "ordinal", "held", F.explode(F.sequence(F.lit(0), "last")).alias("side"))
    )
    scored = stored(held.mapInArrow(_divergence_rows(spans, totals, sizes, top), "kind int, g int, other long, value long"), "divergence")

    other = known.select(F.col("g").cast("long").alias("other"), F.col("l").alias("other_l"), F.col("source").alias("item"))
    none = known.where("size = 0").alias("a").join(other, (F.col("l") == F.col("other_l")) & (F.col("g") != F.col("other")))
    pairs = (
        scored.where("kind = 0 and g != other").groupBy("g", "other").agg(F.sum("value").alias("value")).join(known, "g").join(other, "other")
        .select("lang", "source", "item", "value", "g")
        .unionByName(none.select("lang", "source", "item", F.lit(0).cast("long").alias("value"), "g"))
    )
    order = Window.partitionBy("g")
    pairs = pairs.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "item")))
    best = scored.where("kind = 1").withColumnRenamed("other", "ordinal")
    best = best.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    terms = best.join(known, "g").join(kept.terms().withColumnRenamed("term", "item"), ["lang", "ordinal"])
    parts = [t.select("lang", "source", F.lit(p).alias("part"), "item", "value", "rank") for t, p in ((pairs, "pair"), (terms, "term"))]
    return parts[0].unionByName(parts[1])
