"""Near-duplicates by one-permutation hashing, banded buckets and star-shaped candidates.

One hash of each shingle fills all bins of a signature; empty bins are filled by
optimal densification (Shrivastava 2017). Equal sets are one class and take part
once. In every bucket of a band the members are compared with the smallest one
only; links are confirmed on the full sets. A bucket that still holds several
components afterwards is compared inside tasks: all members outside its largest
component visit every block of its members, and only confirmed links are written,
so that no link is lost to the star shape.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.graph import components
from feedloom.llm.storage import stored
from feedloom.llm.text_arrays import TO_LOWER, as_long, blocks, mix, window_hashes

WORDS = 5
BITS = 7  # 128 bins
BINS = 1 << BITS
ROWS = 4  # of a band: a pair of similarity 0.75 misses all 32 bands with probability 5e-6
BANDS = BINS // ROWS
PERCENT = 75
BLOCK = 512  # members of a bucket that visitors are compared with at a time
SKETCH = 64  # 64-bit words of the bitmap that bounds what two sets share


def _pick_table(attempts: int) -> np.ndarray:
    spots = np.arange(attempts * BINS, dtype=np.uint64)
    return (mix(spots + np.uint64(0xABCDEF)) >> np.uint64(64 - BITS)).astype(np.int64).reshape(attempts, BINS)


PICK = _pick_table(64)


def densify(signature: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill each empty bin from the first full bin that its own sequence of bins meets."""
    out, todo = signature.copy(), ~full
    rows = np.flatnonzero(todo.any(1) & full.any(1))
    attempt = 0
    while len(rows):
        if attempt < len(PICK):
            pick = PICK[attempt]
        else:
            spots = np.arange(attempt * BINS, (attempt + 1) * BINS, dtype=np.uint64)
            pick = (mix(spots + np.uint64(0xABCDEF)) >> np.uint64(64 - BITS)).astype(np.int64)
        hit = todo[rows] & full[rows][:, pick]
        r, c = np.nonzero(hit)
        out[rows[r], c] = signature[rows[r], pick[c]]
        todo[rows[r], c] = False
        rows = rows[todo[rows].any(1)]
        attempt += 1
    return out


def shingle_sets(block) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document of a block."""
    low = TO_LOWER[block.data]
    starts, ends, owner = block.words()
    words = block.hasher(low)(starts, ends)
    at, hashes = window_hashes(words, owner, WORDS)
    bounds = np.searchsorted(owner[at], np.arange(block.n_docs + 1))
    first = np.searchsorted(owner, np.arange(block.n_docs + 1))
    sets = []
    for i in range(block.n_docs):
        some = np.sort(hashes[bounds[i] : bounds[i + 1]])
        if len(some):
            new = np.ones(len(some), bool)
            np.not_equal(some[1:], some[:-1], out=new[1:])
            some = some[new]
        elif first[i] < first[i + 1]:  # fewer words than a shingle: the whole sequence
            key = hashlib.blake2b(words[first[i] : first[i + 1]].tobytes(), digest_size=8).digest()
            some = np.frombuffer(key, np.uint64)
        sets.append(some)
    return sets


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the lowest byte of every bin, for sets that are not empty."""
    values = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins = (s >> np.uint64(64 - BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))  # the smallest hash of each bin
        values[i, bins[first]] = s[first]
        full[i, bins[first]] = True
    values = densify(values, full)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    keys += np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys ^ values[:, r::ROWS])
    return keys, mix(values).astype(np.uint8)


def set_number(shingles: np.ndarray) -> int:
    """A signed 64-bit number of a set; equal sets, and hardly any others, have the same."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            sets = shingle_sets(block)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys, _ = signatures([sets[i] for i in some])
            bands: list = [None] * len(sets)
            for i, k in zip(some, keys.view(np.int64)):
                bands[i] = k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(block.first, block.n_docs),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_number(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "node", "bands"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            sets = shingle_sets(block)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_number(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), as_long(flat))],
                names=["node", "shingles"],
            )


def bitmaps(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set, and how many of its shingles share a bit with another one."""
    sizes = np.diff(ends)
    bit = mix(flat) >> np.uint64(64 - (64 * SKETCH).bit_length() + 1)
    maps = np.zeros((len(sizes), SKETCH), np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    np.bitwise_or.at(maps, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return maps, sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)


def _links_in_block(group: pa.Table) -> pa.Table:
    """Links between the visitors and the members of a block of a bucket, compared with the full sets.

    Two sets share at most the bits that both bitmaps have and the shingles that have no
    bit of their own; pairs that can't reach the similarity by this bound are left out,
    and each pair is compared only in the first band that it shares.
    """
    node, component = (group.column(c).to_numpy() for c in ("node", "component"))
    visits = group.column("visits").to_numpy(zero_copy_only=False)
    bucket = group.column("bucket")[0].as_py()
    bands = np.array(group.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
    band = int(np.flatnonzero((bands == bucket).any(0)).min(initial=BANDS))
    sets = group.column("shingles").combine_chunks()
    ends, flat = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy().view(np.uint64)
    sizes = np.diff(ends)
    maps, hidden = bitmaps(flat[: ends[-1]], ends)
    there = np.flatnonzero(~visits)
    links = []
    for i in np.flatnonzero(visits):
        least, most = np.minimum(sizes[i], sizes[there]), np.maximum(sizes[i], sizes[there])
        near = there[(component[there] != component[i]) & (100 * least >= PERCENT * most)]
        shared = np.bitwise_count(maps[i] & maps[near]).sum(1, dtype=np.int64) + np.minimum(hidden[i], hidden[near])
        near = near[100 * shared >= PERCENT * (sizes[i] + sizes[near] - shared)]
        near = near[~(bands[near, :band] == bands[i, :band]).any(1)]
        x = flat[ends[i] : ends[i + 1]]
        for j in near:
            y = flat[ends[j] : ends[j + 1]]
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int(np.count_nonzero(y[at] == x))
            if 100 * common >= PERCENT * (len(x) + len(y) - common):
                links.append((min(node[i], node[j]), max(node[i], node[j])))
    return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    sizes = F.size("a") + F.size("b")
    close = PERCENT * F.greatest(F.size("a"), F.size("b")) <= 100 * F.least(F.size("a"), F.size("b"))
    return (
        pairs.join(left, "u")
        .join(right, "v")
        .where(close & (100 * common >= PERCENT * (sizes - common)))
        .select("u", "v")
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    A text's set holds its distinct runs of five words (A-Z in lower case; words
    are what ASCII white space parts); with fewer words the whole sequence is one
    shingle. Texts are linked at a Jaccard similarity of 0.75 or more; a component
    is named by its smallest doc_id, the one that stays.

    Nulls: a null or empty text has no shingles and no links; a row with a null
    doc_id has none either, its component is null and it stays. Rows that share a
    doc_id are one document, linked through any of its texts, and get one
    component. An empty table gives no rows. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(texts.mapInArrow(_signature_rows, "doc_id long, n_shingles long, node long, bands array<long>"), "signatures")
    members = signed.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    classes = stored(members.groupBy("node").agg(F.min("doc_id").alias("least")), "classes")
    # Several rows under one id are one document: its classes are united, and its rows of one class count once.
    ids = members.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    ids = stored(ids, "repeated-ids")
    repeats = ids.limit(1).count() > 0
    united = members.join(ids.where("u < v").select("doc_id", "u"), "doc_id").select("u", F.col("node").alias("v")).where("u != v")
    # The row that names a class brings its signature.
    own = members.join(classes.withColumnRenamed("node", "class"), (F.col("doc_id") == F.col("least")) & (F.col("node") == F.col("class")))
    own = own.select("node", "bands")
    own = own.dropDuplicates(["node"]) if repeats else own
    banded = stored(own.select("node", F.explode("bands").alias("bucket")), "buckets")

    centres = banded.groupBy("bucket").agg(F.min("node").alias("u"), F.max("node").alias("top")).where("u < top")
    stars = banded.join(centres.drop("top"), "bucket").where("u != node").groupBy("u", F.col("node").alias("v"))
    stars = stored(stars.agg(F.count("*").alias("n")), "stars")

    wanted = stars.select(F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("node"))).distinct()
    # Stored, so that Spark plans the join by the true size of the ids; most texts have no partner.
    wanted = stored(classes.join(wanted, "node", "left_semi").select(F.col("least").alias("wanted")).distinct(), "wanted")
    sets = texts.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi").mapInArrow(_set_rows, "node long, shingles array<long>")
    sets = stored(sets.dropDuplicates(["node"]) if repeats else sets, "sets")

    # The centre that a member meets most often comes first; once that has settled most members,
    # only stars between different components are left to confirm.
    likely = stars.groupBy("v").agg(F.max(F.struct("n", "u")).alias("m")).select("m.u", "v")
    links = stored(_confirm(likely, sets).unionByName(united), "links")
    others = _across(stars.select("u", "v").join(likely, ["u", "v"], "left_anti"), components(links))
    # Stored, so that Spark knows its size; only the sets that these pairs name are shuffled.
    others = stored(others, "others")
    ends = others.select(F.col("u").alias("node")).unionByName(others.select(F.col("v").alias("node"))).distinct()
    links = stored(links.unionByName(_confirm(others, sets.join(ends, "node", "left_semi"))), "links")
    found = stored(components(links), "components")

    late = stored(_late_links(banded, own, sets, stars, found), "links")
    if late.limit(1).count():
        found = stored(components(links.unionByName(late)), "components")
    return _with_components(signed, classes, found)


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose two nodes are in different components."""
    ends = found.select("node", "component")
    left = pairs.join(ends.toDF("u", "cu"), "u", "left").join(ends.toDF("v", "cv"), "v", "left")
    return left.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def _late_links(banded: DataFrame, own: DataFrame, sets: DataFrame, stars: DataFrame, found: DataFrame) -> DataFrame:
    """``u, v``: links between different components that share a bucket, its star apart."""
    starred = stars.select(F.col("v").alias("node")).unionByName(stars.select(F.col("u").alias("node"))).distinct()
    placed = (
        banded.join(starred, "node", "left_semi")
        .join(found, "node", "left")
        .select("bucket", "node", F.coalesce("component", "node").alias("component"))
    )
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = (
        parts.groupBy("bucket")
        .agg(F.count("*").alias("n_parts"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("largest"))
        .where("n_parts > 1 and size > 2")  # of two members, the star has compared the only pair
        .select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("n_blocks"), F.col("largest.component").alias("largest"))
    )
    # Every member stands in one block; those outside the largest component visit all blocks.
    crowded = stored(placed.join(split, "bucket"), "crowded")
    there = crowded.select("bucket", F.pmod(F.xxhash64("node"), "n_blocks").cast("int").alias("block"), "node", "component", F.lit(False).alias("visits"))
    visits = crowded.where("component != largest").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "node", "component", F.lit(True).alias("visits")
    )
    return (
        there.unionByName(visits)
        .join(own.join(sets, "node"), "node")
        .groupBy("bucket", "block")
        .applyInArrow(_links_in_block, "u long, v long")
        .distinct()
    )


def _with_components(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Every row with the smallest doc_id of its component."""
    joined = classes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    names = stored(joined.join(least, "component").select(F.col("node").alias("class"), "component_id"), "names")
    joined = signed.select("doc_id", "n_shingles", "node").join(names, F.col("node") == F.col("class"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that name their group or have none."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
