"""SimHash near-duplicates by anchor points of a covering code.

The fingerprints are cut into blocks of bits, and each block has a perfect linear
code: every value lies within the code's covering radius of one codeword. A tuple
of codewords is an anchor. A fingerprint's home is the one anchor within the radius
in every block. A partner that differs in ``THRESHOLD`` bits at most is, block by
block, no further from that anchor than radius plus its differing bits, so it is
replicated to all anchors whose excess over the radii sums up to ``THRESHOLD`` or
less. Homes are compared with all members of their anchor; no link can be missed.
The code follows the counted number of fingerprints: finer ones cost more replicas
and save comparisons, and every one of them gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.graph import components
from feedloom.llm.storage import BATCH_ROWS, stored
from feedloom.llm.text_arrays import TO_LOWER, blocks, mix

WORDS = 3
SEED = 42
THRESHOLD = 3
# Block width, generator polynomial and covering radius of perfect cyclic codes.
GOLAY = (23, 0b110001110101, 3)
HAMMING_15 = (15, 0b10011, 1)
HAMMING_7 = (7, 0b1011, 1)
CODES = ((GOLAY,), (GOLAY, HAMMING_7), (GOLAY, GOLAY), (GOLAY, GOLAY, HAMMING_15))
# Seconds that a replica and a comparison cost, for the choice among the codes.
REPLICA_COST, PAIR_COST = 1.5e-6, 12e-9
CELL = 1 << 15  # members, and homes, that are compared in one place
SLOTS = 1 << 16  # counters of members; anchors that share one are told apart by nothing but their splitting
PAIRS = 1 << 21  # compared in one numpy step
STEP = 1 << 16  # shingles hashed, or rows compared, at a time
REPLICAS = "cell long, home boolean, fingerprint long"


def fingerprints(block) -> np.ndarray:
    """The 64-bit fingerprint of every document of a block of texts."""
    low = TO_LOWER[block.data]
    starts, ends, owner = block.words(low)
    sizes = ends - starts
    # Words in a row with one space after each; a shingle is a range of these bytes.
    space = np.ones(len(low), bool)
    inside = np.zeros(len(low) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    space = np.cumsum(inside[:-1], dtype=np.int8) == 0 if len(low) else space
    flat = np.full(int((sizes + 1).sum()), 32, np.uint8)
    kept = low[~space]
    flat[np.arange(len(kept)) + np.repeat(np.arange(len(sizes)), sizes)] = kept
    stops = np.cumsum(sizes + 1) - 1
    begins = stops - sizes
    n_words = np.bincount(owner, minlength=block.n_docs)
    first = np.cumsum(n_words) - n_words
    whole = owner[: max(0, len(owner) - WORDS + 1)] == owner[WORDS - 1 :] if len(owner) >= WORDS else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    at = np.concatenate([at, first[short]])
    last = np.concatenate([at[: len(at) - len(short)] + WORDS - 1, first[short] + n_words[short] - 1])
    order = np.argsort(at, kind="stable")
    at, last = at[order], last[order]
    doc = owner[at]
    total = np.bincount(doc, minlength=block.n_docs)
    ones = np.zeros((block.n_docs, 64), np.int64)
    text, digest = flat.tobytes(), xxhash.xxh64_intdigest
    for i in range(0, len(at), STEP):
        a, z, d = begins[at[i : i + STEP]], stops[last[i : i + STEP]], doc[i : i + STEP]
        h = np.array([digest(text[x:y], SEED) for x, y in zip(a.tolist(), z.tolist())], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        runs = np.flatnonzero(np.diff(d, prepend=-1))
        ones[d[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int32)
    set_bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0]


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            own = batch.column("doc_id").slice(block.first, block.n_docs)
            yield pa.RecordBatch.from_arrays([own, pa.array(fingerprints(block).view(np.int64))], names=["doc_id", "fingerprint"])


class BlockCode:
    """A perfect cyclic code: for every syndrome the error patterns, by their excess over the radius."""

    def __init__(self, width: int, generator: int, radius: int):
        self.width, self.check_bits = width, generator.bit_length() - 1
        self.powers, power = [], 1
        for _ in range(width):
            self.powers.append(power)
            power <<= 1
            if power >> self.check_bits:
                power ^= generator
        patterns = np.arange(1 << width, dtype=np.uint32)
        weight = np.bitwise_count(patterns)
        patterns = patterns[weight <= radius + THRESHOLD]
        excess = np.maximum(np.bitwise_count(patterns).astype(np.int64) - radius, 0)
        syndrome = self.syndrome(patterns.astype(np.uint64))
        order = np.lexsort((patterns, syndrome, excess))
        self.patterns = patterns[order].astype(np.uint64)
        ranks = (excess * (1 << self.check_bits) + syndrome)[order]
        grid = np.arange((THRESHOLD + 1) << self.check_bits)
        self.begin = np.searchsorted(ranks, grid).reshape(THRESHOLD + 1, -1)
        self.count = np.searchsorted(ranks, grid, side="right").reshape(THRESHOLD + 1, -1) - self.begin

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for bit, power in enumerate(self.powers):
            out ^= ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * power
        return out


@lru_cache(maxsize=8)
def block_code(width: int, generator: int, radius: int) -> BlockCode:
    return BlockCode(width, generator, radius)


def replicas(values: np.ndarray, code: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows, their anchors, and whether these are their homes, for fingerprints of 64 bits."""
    parts, shift = [], 0
    for block in code:
        own = block_code(*block)
        value = (values >> np.uint64(shift)) & np.uint64((1 << own.width) - 1)
        parts.append((own, shift, value, own.syndrome(value)))
        shift += own.width
    for shares in product(range(THRESHOLD + 1), repeat=len(code)):
        if sum(shares) > THRESHOLD:
            continue
        counts = [own.count[e][syndrome] for e, (own, _, _, syndrome) in zip(shares, parts)]
        total = np.prod(counts, axis=0)
        rows = np.repeat(np.arange(len(values)), total)
        k = np.arange(len(rows)) - np.repeat(np.cumsum(total) - total, total)
        anchors = np.zeros(len(rows), np.uint64)
        for e, n, (own, at, value, syndrome) in zip(shares, counts, parts):
            k, pick = np.divmod(k, n[rows])
            pattern = own.patterns[own.begin[e][syndrome[rows]] + pick]
            anchors |= (value[rows] ^ pattern) << np.uint64(at)
        yield rows, anchors, not any(shares)


def mean_replicas(code: tuple) -> float:
    """Replicas of a fingerprint whose bits are even."""
    means = [block_code(*block).count.mean(axis=1) for block in code]
    return float(sum(np.prod([m[e] for m, e in zip(means, shares)]) for shares in product(range(THRESHOLD + 1), repeat=len(code)) if sum(shares) <= THRESHOLD))


def n_anchors(code: tuple) -> int:
    return 1 << sum(width - generator.bit_length() + 1 for width, generator, _ in code)


def choose_code(n: int) -> tuple:
    """The cheapest code for ``n`` distinct fingerprints; all of them find the same links."""
    return min(CODES, key=lambda c: mean_replicas(c) * (REPLICA_COST + PAIR_COST * n / n_anchors(c)))


def _slot(anchors: np.ndarray) -> np.ndarray:
    return (mix(anchors) >> np.uint64(48)).astype(np.int64)  # SLOTS values


def count_members(code: tuple):
    """Members and homes of every slot of anchors, one row a slot and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, homes = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for batch in batches:
            values = batch.column("fingerprint").to_numpy().view(np.uint64)
            for _, anchors, home in replicas(values, code):
                n = np.bincount(_slot(anchors), minlength=SLOTS)
                members += n
                homes += n * home
        some = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(members[some]), pa.array(homes[some])], names=["slot", "members", "homes"]
        )

    return run


def replicate(code: tuple, crowded: dict[int, tuple[int, int]]):
    """``cell, home, fingerprint`` of all replicas.

    An anchor in a crowded slot is split into a grid: its homes are dealt to rows and
    stand in every column, the members are dealt to columns and stand in every row.
    """
    n_rows, n_columns = np.ones(SLOTS, np.int64), np.ones(SLOTS, np.int64)
    for slot, (r, c) in crowded.items():
        n_rows[slot], n_columns[slot] = r, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fingerprint").to_numpy().view(np.uint64)
            lot = (mix(values) >> np.uint64(33)).astype(np.int64)
            for rows, anchors, home in replicas(values, code):
                slot = _slot(anchors)
                r, c = n_rows[slot], n_columns[slot]
                for is_home in (True, False) if home else (False,):
                    times, dealt = (c, lot[rows] % r) if is_home else (r, lot[rows] % c)
                    if (times > 1).any():
                        again = np.repeat(np.arange(len(rows)), times)
                        turn = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                    else:
                        again, turn = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                    i, j = (dealt[again], turn) if is_home else (turn, dealt[again])
                    cell = mix(anchors[again] ^ mix(((i << 32) + j + 1).view(np.uint64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell.view(np.int64)), pa.array(np.full(len(cell), is_home)), pa.array(values[rows[again]].view(np.int64))],
                        names=["cell", "home", "fingerprint"],
                    )

    return run


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest labels after uniting u[i] with v[i]."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def links_of(cell: np.ndarray, home: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that are connected by links inside the cells, each with the first one of its tree.

    Rows come sorted by cell, homes first. Trees instead of links keep the output
    below the number of rows however many fingerprints are close to each other.
    """
    known, node = np.unique(value, return_inverse=True)
    label = np.arange(len(known))
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[starts, len(cell)])
    group = np.repeat(np.arange(len(starts)), size)
    left = np.flatnonzero(home)
    todo = np.cumsum(size[group[left]])
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(todo, (todo[i - 1] if i else 0) + PAIRS, side="right")))
        n = size[group[left[i:j]]]
        a = np.repeat(left[i:j], n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + starts[group[a]]
        near = np.flatnonzero(np.bitwise_count(value[a] ^ value[b]) <= THRESHOLD)
        label = _unite(label, node[a[near]], node[b[near]])
        i = j
    moved = np.flatnonzero(label != np.arange(len(label)))
    return known[label[moved]], known[moved]


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def links(rows) -> pa.RecordBatch:
        u, v = links_of(rows[0], rows[1], rows[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        held.append((batch.column("cell").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False), batch.column("fingerprint").to_numpy()))
        n += len(held[-1][0])
        if n < STEP:
            continue
        rows = [np.concatenate(c) for c in zip(*held)]
        whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last cell may go on
        if whole:
            yield links([c[:whole] for c in rows])
        held = [tuple(c[whole:] for c in rows)]
        n = len(held[0][0])
    if n:
        yield links([np.concatenate(c) for c in zip(*held)])


def close_fingerprints(values: DataFrame, code: tuple | None = None) -> DataFrame:
    """``u, v``: pairs that connect all distinct ``fingerprint`` values within ``THRESHOLD`` bits.

    The pairs are spanning trees of the links of each place of comparison: their
    connected components are those of all links.
    """
    spark = values.sparkSession
    code = code or choose_code(values.count())
    # One row a slot at most comes to the driver, and only crowded ones, of which there are few.
    crowded = (
        values.mapInArrow(count_members(code), "slot long, members long, homes long")
        .groupBy("slot")
        .agg(F.sum("members").alias("members"), F.sum("homes").alias("homes"))
        .where(f"members > {CELL}")
        .collect()
    )
    grid = {r["slot"]: (-(-r["homes"] // CELL) or 1, -(-r["members"] // CELL)) for r in crowded}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(STEP // 4))
    try:
        placed = values.mapInArrow(replicate(code, grid), REPLICAS).repartition("cell")
        placed = placed.sortWithinPartitions("cell", F.col("home").desc())
        return stored(placed.mapInArrow(_cell_links, "u long, v long").distinct(), "simhash-links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def near_duplicates(docs: DataFrame, code: tuple | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Shingles are runs of three words (A-Z in lower case; words are what ASCII white
    space parts), repeats included, joined by single spaces; fewer words are one
    shingle. A bit is set if it is set in over half of the shingles' XXH64 values.
    Rows are linked if their fingerprints differ in three bits at most; a component
    is named by its smallest doc_id.

    Nulls: a null or empty text, or one of white space, has fingerprint zero and is
    linked like any other; a row with a null doc_id links nothing and its component
    is null. Rows that share a doc_id are one document, linked through any of its
    texts. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = stored(rows.mapInArrow(_fingerprint_rows, "doc_id long, fingerprint long"), "fingerprints")
    named = marked.where("doc_id is not null")
    classes = stored(named.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-classes")
    links = close_fingerprints(classes.select("fingerprint"), code)
    # Several texts under one id are one document.
    span = named.groupBy("doc_id").agg(F.min("fingerprint").alias("u"), F.max("fingerprint").alias("top")).where("u < top")
    same = named.join(span.select("doc_id", "u"), "doc_id").select("u", F.col("fingerprint").alias("v")).where("u != v")
    found = stored(components(links.unionByName(same)), "simhash-components")
    joined = classes.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    names = stored(joined.join(least, "component").select("fingerprint", "component_id"), "simhash-names")
    names = names.withColumnRenamed("fingerprint", "own")
    return marked.join(names, F.col("fingerprint") == F.col("own"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
