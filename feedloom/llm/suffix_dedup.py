"""Remove byte strings that an earlier document holds, by suffix arrays of shards.

1. Of equal whole texts the smallest document stands for all; the others go as a
   whole and take no further part.
2. Winnowing marks anchors, 20-byte strings so chosen that equal 50-byte strings
   hold an equal anchor at the same place. Anchors that one text alone has are
   out; this first look goes by hash and may only let too much pass.
3. The others are dealt out with the 30 bytes on both sides, range-partitioned and
   sorted by anchor and context. A very common anchor spreads over many shards, any
   other stays in one.
4. Each shard builds the suffix array of its distinct contexts (Larsson-Sadakane) and
   the common prefixes of neighbours. Suffixes that share 50 bytes are one class; in it,
   all documents but the smallest lose the string. Where all rows of an anchor have
   one context, or one document, that is known without it.
5. Very common anchors that cross the border of a shard leave the sorted class table
   of their strings; the tables are dealt out by string range and merged by binary
   search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import keyed_texts, same_row, stored
from feedloom.llm.suffix_array import common_prefixes, suffix_array
from feedloom.llm.text_arrays import Block, as_long, blocks

MATCH = 50
ANCHOR = 20
SIDE = MATCH - ANCHOR
HOT = 1 << 15  # rows of an anchor that may be cut at shard borders; fewer are some 2.6 MB of contexts
BUCKET = 1 << 25  # bytes of anchor hashes that are looked at together
SAMPLE = 0.01
SHARD = 1 << 20  # bytes of distinct contexts in one suffix array
BLOCK = 1 << 19
PIECE = 1 << 16  # bytes of texts whose windows are hashed at a time: their arrays stay in a core's cache


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: the least hashes of all runs of SIDE + 1 of them."""
    places, found, i = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while i < block.n_docs:
        begin = block.offsets[i]
        j = max(i + 1, int(np.searchsorted(block.offsets, begin + PIECE, side="right")) - 1)
        at, hashes = _anchors(Block(block.data[begin : block.offsets[j]], block.offsets[i : j + 1] - begin, i))
        places.append(at + begin)
        found.append(hashes)
        i = j
    return np.concatenate(places), np.concatenate(found)


def _anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    n = len(block.data) - MATCH + 1  # windows
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = block.windows(ANCHOR)
    least = _sliding(hashes, np.minimum)
    owner = np.repeat(np.arange(block.n_docs), np.diff(block.offsets))
    least[owner[:n] != owner[MATCH - 1 :]] = 0  # a window across documents marks nothing
    padded = np.concatenate([np.zeros(SIDE, np.uint64), least, np.zeros(SIDE, np.uint64)])
    some = np.flatnonzero(_sliding(padded, np.maximum) == hashes)
    return some, hashes[some]


def _sliding(x: np.ndarray, best) -> np.ndarray:
    """The best of each run of SIDE + 1 (31) values."""
    width = 1
    while 2 * width <= SIDE + 1:
        x = best(x[: len(x) - width], x[width:])
        width *= 2
    rest = SIDE + 1 - width
    return best(x[: len(x) - rest], x[rest:])


def _deal_anchors(n_buckets: int):
    """One row for each block and bucket: hashes found in the block, once each, and which texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("text_key").to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text"), 4 * BLOCK):
                at, hashes = anchors(block)
                own = ids[block.first + block.owner(at)]
                order = np.lexsort((own, hashes))
                hashes, own = hashes[order], own[order]
                first = np.ones(len(own), bool)
                first[1:] = hashes[1:] != hashes[:-1]
                starts = np.flatnonzero(first)
                several = np.zeros(len(own), bool)  # of several texts here
                if len(starts):
                    ends = np.append(starts[1:], len(own))
                    several = np.repeat(own[starts] != own[ends - 1], ends - starts)
                # Texts after the first know already that they share the anchor.
                known = several & ~first & np.append(True, own[1:] != own[:-1])
                bucket = (hashes % np.uint64(n_buckets)).astype(np.int32)
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                for kind, rows in ((0, np.flatnonzero(first)), (1, np.flatnonzero(known))):
                    rows = rows[np.argsort(bucket[rows], kind="stable")]
                    cuts = np.flatnonzero(np.diff(bucket[rows], prepend=-1))
                    for i, j in zip(cuts, np.append(cuts[1:], len(rows))):
                        part = rows[i:j]
                        yield _hash_row(int(bucket[part[0]]), kind, short[part], own[part], several[part])

    return run


HASHES = "bucket int, kind int, hashes binary, texts binary, several binary"


def _hash_row(bucket: int, kind: int, hashes: np.ndarray, docs: np.ndarray, several: np.ndarray) -> pa.RecordBatch:
    cells = [hashes.tobytes(), docs.astype(np.int64).tobytes(), np.packbits(several).tobytes()]
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)],
        names=["bucket", "kind", "hashes", "texts", "several"],
    )


def _shared_hashes(group: pa.Table) -> pa.Table:
    """``text_key, hashes``: of a bucket, the hashes that several texts have."""
    found, docs, kinds, several = [], [], [], []
    for kind, h, d, s in zip(*(group.column(c).to_pylist() for c in ("kind", "hashes", "texts", "several"))):
        found.append(np.frombuffer(h, np.uint32))
        docs.append(np.frombuffer(d, np.int64))
        kinds.append(np.full(len(found[-1]), kind))
        several.append(np.unpackbits(np.frombuffer(s, np.uint8), count=len(found[-1])).astype(bool))
    found, docs, kinds, several = map(np.concatenate, (found, docs, kinds, several))
    # Sorted by hash and text: shared are the hashes that are marked or have more than one text.
    order = np.lexsort((docs, found))
    found, docs, keep = found[order], docs[order], (kinds == 1)[order]
    starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    ends = np.r_[starts[1:], len(found)] - 1
    shared = (docs[starts] != docs[ends]) | np.logical_or.reduceat(several[order], starts)
    keep |= np.repeat(shared, np.diff(np.r_[starts, len(found)]))
    keep[1:] &= (found[1:] != found[:-1]) | (docs[1:] != docs[:-1])  # a text's copies say it again
    docs, found = docs[keep], found[keep]
    order = np.argsort(docs, kind="stable")
    docs, found = docs[order], found[order]
    cuts = np.flatnonzero(np.diff(docs, prepend=docs[0] - 1)) if len(docs) else np.zeros(0, int)
    cells = [found[i:j].tobytes() for i, j in zip(cuts, np.append(cuts[1:], len(docs)))]
    return pa.table({"text_key": pa.array(docs[cuts], pa.int64()), "hashes": pa.array(cells, pa.binary())})


CONTEXTS = "anchor long, context binary, at int, doc long, text_key long, place long"


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a document whose hash is shared, with the bytes on both sides."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys = batch.column("text_key").to_numpy(zero_copy_only=False)
        shared = [np.concatenate([np.frombuffer(x, np.uint32) for x in some]) for some in batch.column("shared").to_pylist()]
        for block in blocks(batch.column("text"), BLOCK):
            at, hashes = anchors(block)
            owner = block.owner(at)
            bounds = np.searchsorted(owner, np.arange(block.n_docs + 1))
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            keep = np.concatenate(
                [np.isin(short[bounds[i] : bounds[i + 1]], shared[block.first + i]) for i in range(block.n_docs)]
            )
            at, hashes, owner = at[keep], hashes[keep], owner[keep]
            left = np.maximum(at - SIDE, block.offsets[owner])
            right = np.minimum(at + ANCHOR + SIDE, block.offsets[owner + 1])
            size = right - left
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            spots = np.arange(ends[-1]) + np.repeat(left - ends[:-1], size)
            contexts = pa.BinaryArray.from_buffers(
                pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(block.data[spots])]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    as_long(hashes), contexts, pa.array((at - left).astype(np.int32)), as_long(ids[block.first + owner]),
                    as_long(keys[block.first + owner]), as_long(left - block.offsets[owner]),
                ],
                names=["anchor", "context", "at", "doc", "text_key", "place"],
            )


MATCHES = "kind int, doc long, text_key long, first long, last long, window binary"
COVERED, BORDER = 0, 1


def _match_rows(kind: int, doc, key, first, last, window) -> pa.RecordBatch:
    n = len(doc)
    window = pa.nulls(n, pa.binary()) if window is None else window
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (doc, key, first, last)), window],
        names=["kind", "doc", "text_key", "first", "last", "window"],
    )


def _shard(table: pa.RecordBatch, open_left: bool, open_right: bool) -> Iterator[pa.RecordBatch]:
    """Matches inside a shard; strings of its first and last anchor, if these go on beyond it."""
    anchor, doc, key, place = (table.column(c).to_numpy() for c in ("anchor", "doc", "text_key", "place"))
    cells = table.column("context")
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data = np.frombuffer(cells.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    # Rows are sorted by anchor, context and document: equal contexts stand together.
    sizes = np.diff(ends)
    digest = Block(data, ends, 0).hasher()(ends[:-1], ends[1:])
    fresh = np.r_[True, anchor[1:] != anchor[:-1]]
    new = fresh.copy()
    new[1:] |= (digest[1:] != digest[:-1]) | (sizes[1:] != sizes[:-1])
    head = np.flatnonzero(new)  # the first row of each context holds its smallest document
    least_of = doc[head][np.cumsum(new) - 1]
    # Whoever repeats a smaller document's context loses all of it.
    again = np.flatnonzero((doc > least_of) & (sizes >= MATCH))
    if len(again):
        yield _match_rows(COVERED, doc[again], key[again], place[again], place[again] + sizes[again], None)

    edge = np.zeros(len(doc), bool)
    if open_left:
        edge |= anchor == anchor[0]
    if open_right:
        edge |= anchor == anchor[-1]
    starts = np.flatnonzero(fresh)
    alike = np.add.reduceat(new.astype(np.int64), starts) == 1
    alike |= np.minimum.reduceat(doc, starts) == np.maximum.reduceat(doc, starts)
    open_rows = edge | ~np.repeat(alike, np.diff(np.r_[starts, len(doc)]))
    rest = np.flatnonzero(open_rows & (doc == least_of))
    if not len(rest):
        return
    head = np.flatnonzero(new & open_rows)
    which = np.searchsorted(head, rest, side="right") - 1
    size = sizes[head]
    begin = np.concatenate([[0], np.cumsum(size)])
    text = data[np.arange(begin[-1]) + np.repeat(ends[head] - begin[:-1], size)]

    order = suffix_array(text)
    owner = np.repeat(np.arange(len(head)), size)
    spot = np.arange(len(text)) - begin[owner]
    suffix = order[spot[order] + MATCH <= size[owner[order]]]  # suffixes whose first 50 bytes lie in their context
    if not len(suffix):
        return
    group = np.cumsum(common_prefixes(text, suffix, MATCH) < MATCH) - 1
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[head[owner[suffix]]])
    lowest = np.empty(len(text), np.int64)
    lowest[suffix] = least[group]
    # For each row, the first and last window of its context that a smaller document has.
    doc, key, place, edge = doc[rest], key[rest], place[rest], edge[rest]
    first, reach = begin[:-1][which], np.maximum(0, size[which] - MATCH + 1)
    row = np.repeat(np.arange(len(doc)), reach)
    step = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach)
    known = lowest[first[row] + step]
    hit = known < doc[row]
    r, t = row[hit], step[hit]
    if len(r):
        cut = np.flatnonzero(np.diff(r, prepend=-1))
        last = np.append(cut[1:], len(r)) - 1
        r = r[cut]
        yield _match_rows(COVERED, doc[r], key[r], place[r] + t[cut], place[r] + t[last] + MATCH, None)
    mine = edge[row] & (known == doc[row])  # the others are matched already
    row, step = row[mine], step[mine]
    if len(row):
        spots = (first[row] + step)[:, None] + np.arange(MATCH)
        flat = text[spots].ravel()
        window = pa.FixedSizeBinaryArray.from_buffers(pa.binary(MATCH), len(row), [None, pa.py_buffer(flat)]).cast(pa.binary())
        yield _match_rows(BORDER, doc[row], key[row], place[row] + step, place[row] + step + MATCH, window)


def _match_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into shards, inside an anchor only if it is a very common one."""
    held: list[pa.RecordBatch] = []
    n_bytes, most, begins = 0, SHARD, None  # begins: the anchor that the last shard was cut in

    def shard(table: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        anchor, hot = table.column("anchor").to_numpy(), table.column("hot")
        open_left = hot[0].as_py() and begins in (None, int(anchor[0]))
        return _shard(table, open_left, last and hot[len(anchor) - 1].as_py())

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n_bytes += batch.column("context").nbytes
        if n_bytes < most:
            continue
        table = pa.concat_batches(held)
        anchor = table.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield from shard(table.slice(0, cut), False)
            held, begins = [table.slice(cut)], int(anchor[cut - 1])
        elif table.column("hot")[0].as_py():
            yield from shard(table, True)
            held, begins = [], int(anchor[0])
        else:
            held = [table]
        n_bytes = sum(b.column("context").nbytes for b in held)
        most = max(SHARD, 2 * n_bytes)
    if held:
        yield from shard(pa.concat_batches(held), True)


def _merge_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of one range: by binary search each finds its class and the smallest document in it."""
    held = None
    for batch in [*batches, None]:
        table = pa.Table.from_batches([x for x in (held, batch) if x is not None]) if held is not None or batch is not None else None
        if table is None or not table.num_rows:
            continue
        table = table.combine_chunks()
        window = np.array(table.column("window").to_pylist(), f"S{MATCH}")
        # The last string may go on in the next batch.
        stop = table.num_rows if batch is None else int(np.searchsorted(window, window[-1]))
        held = table.slice(stop).to_batches()[0] if stop < table.num_rows else None
        if not stop:
            held = table.to_batches()[0]
            continue
        doc, key, first, last = (table.column(c).to_numpy()[:stop] for c in ("doc", "text_key", "first", "last"))
        values = np.unique(window[:stop])
        place = np.searchsorted(values, window[:stop])
        least = np.full(len(values), np.iinfo(np.int64).max)
        np.minimum.at(least, place, doc)
        hit = doc > least[place]
        yield _match_rows(COVERED, doc[hit], key[hit], first[hit], last[hit], None)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, spans``: sorted maximal byte ranges ``(first, last)`` to remove from a row.

    A byte goes if a 50-byte string that covers it also starts in a document with
    a smaller doc_id. Texts are UTF-8 bytes; matches never cross documents.

    Nulls: a null text is empty; a row with a null doc_id is compared with nothing.
    Rows that share a doc_id do not match each other. Texts under 50 bytes match
    nothing. An empty table gives no rows. Other columns are ignored.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed_texts(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # Equal texts: 128 bits of hash, so that none is taken for another's copy.
    rows = texts.select("doc_id", "text_key", F.xxhash64(F.lit(1), "text").alias("check"), F.octet_length("text").alias("size"))
    rows = stored(rows, "text-keys")
    classes = stored(rows.groupBy("text_key", "check", "size").agg(F.min("doc_id").alias("least")), "text-classes")
    total = classes.agg(F.sum("size")).first()[0] or 0
    # About one anchor in sixteen bytes, each with twelve bytes of hash and text.
    buckets = max(2 * parts, -(-total // BUCKET))
    dealt = texts.select("text_key", "text").mapInArrow(_deal_anchors(buckets), HASHES)
    shared = stored(dealt.groupBy("bucket").applyInArrow(_shared_hashes, "text_key long, hashes binary"), "shared")
    by_text = shared.groupBy("text_key").agg(F.collect_list("hashes").alias("shared"))  # of one text
    by_text = by_text.join(classes.select("text_key", "least"), "text_key").withColumnRenamed("text_key", "class")
    met = (F.col("doc_id") == F.col("least")) & (F.col("text_key") == F.col("class"))
    contexts = stored(texts.join(by_text.hint("shuffle_hash"), met).mapInArrow(_context_rows, CONTEXTS), "contexts")
    # Only anchors with very many rows may be cut at shard borders; a sample finds them, and what it
    # misses stays in one shard. The result doesn't depend on it.
    common = contexts.sample(SAMPLE, seed=3).groupBy("anchor").count().where(F.col("count") >= SAMPLE * HOT)
    common = stored(common.select(F.col("anchor").alias("common")), "hot-anchors")
    if common.limit(10_001).count() <= 10_000:
        common = F.broadcast(common)
    hot = F.col("hot")
    sorted_contexts = (
        contexts.join(common, F.col("anchor") == F.col("common"), "left")
        .withColumn("hot", F.col("common").isNotNull())
        .drop("common")
        .repartitionByRange(parts, "anchor", F.when(hot, F.col("context")), F.when(hot, F.col("doc")))
        .sortWithinPartitions("anchor", "context", "doc")
    )
    matches = stored(sorted_contexts.mapInArrow(_match_shards, MATCHES), "matches")
    border = matches.where(F.col("kind") == BORDER).select("doc", "text_key", "first", "last", "window")
    merged = border.repartitionByRange(parts, "window").sortWithinPartitions("window").mapInArrow(_merge_borders, MATCHES)
    copies = rows.join(classes, ["text_key", "check", "size"]).where((F.col("doc_id") > F.col("least")) & (F.col("size") >= MATCH))
    copies = copies.select(
        F.lit(COVERED).alias("kind"), F.col("doc_id").alias("doc"), "text_key", F.lit(0).cast("long").alias("first"),
        F.col("size").cast("long").alias("last"), F.lit(None).cast("binary").alias("window"),
    )
    covered = matches.where(F.col("kind") == COVERED).unionByName(merged).unionByName(copies).groupBy("doc", "text_key")
    found = covered.agg(F.collect_set(F.struct("first", "last")).alias("found"))  # of one document
    spans = "array<struct<first: bigint, last: bigint>>"
    return found.select(F.col("doc").alias("doc_id"), "text_key", "found").mapInArrow(
        _merge_spans, f"doc_id long, text_key long, spans {spans}"
    )


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite ranges of a document that overlap or touch."""
    for batch in batches:
        spans = []
        for found in batch.column("found"):
            first, last = (found.values.field(i).to_numpy() for i in (0, 1))
            order = np.argsort(first, kind="stable")
            first, reach = first[order], np.maximum.accumulate(last[order])
            begins = np.append(True, first[1:] > reach[:-1])
            ends = reach[np.append(np.flatnonzero(begins)[1:], len(first)) - 1]
            spans.append([{"first": int(a), "last": int(b)} for a, b in zip(first[begins], ends)])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(spans, kind)], names=["doc_id", "text_key", "spans"]
        )


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    left, at = [], 0
    for first, last in spans:
        left.append(text[at:first])
        at = last
    return b"".join([*left, text[at:]])


def span_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    keyed = keyed_texts(docs)
    spans = repeated_spans(docs).hint("shuffle_hash")
    joined = keyed.join(spans, same_row(keyed, spans), "left").select(keyed["doc_id"], keyed["text"], spans["spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, cut in zip(batch.column("text"), batch.column("spans").to_pylist()):
                raw = text.as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                some = [(x["first"], x["last"]) for x in cut or []]
                rows.append((len(raw), sum(b - a for a, b in some), len(some), hashlib.sha256(remove_spans(raw, some)).hexdigest()))
            cells = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cells, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
