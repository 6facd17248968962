"""Drop lines that many documents share, by range-partitioned line hashes.

Hashes of long lines are range-partitioned by (hash, document) and sorted by
document and position inside each partition. One streaming pass meets the first
occurrence of every key before the others and decides in place; only keys that
touch the border of a partition wait for a border table of two rows a partition.
The result is one compressed bitmap per changed document, never text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.storage import keyed_texts, same_row, stored
from feedloom.llm.text_arrays import TO_LOWER, as_long, blocks

FINAL, PENDING, BORDER = 0, 1, 2
NO_ID = -(1 << 63)  # stands for a null doc_id, smaller than every other
LINES = "h1 long, h2 long, doc long, text_key long, line int"
MARKS = "kind int, h1 long, h2 long, doc long, text_key long, line int, n_docs long"


def line_keys(min_chars: int):
    """Map batches of ``doc, text_key, text`` to one row for each line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "text_key"))
            for block in blocks(batch.column("text")):
                starts, ends, owner = block.lines()
                low = TO_LOWER[block.data]
                first, last, _ = block.words()
                a = np.searchsorted(first, starts)  # first word of the line
                b = np.searchsorted(last, ends, side="right") - 1  # last word of the line
                some = a <= b
                number = np.arange(len(starts)) - np.searchsorted(owner, owner)
                starts, ends = first[a[some]], last[b[some]]
                owner, number = owner[some], number[some]
                points = np.zeros(len(low) + 1, np.int64)
                np.cumsum((low & 0xC0) != 0x80, out=points[1:])
                long = points[ends] - points[starts] >= min_chars
                starts, ends, owner, number = starts[long], ends[long], owner[long], number[long]
                yield pa.RecordBatch.from_arrays(
                    [
                        as_long(block.hasher(low, 0)(starts, ends)),
                        as_long(block.hasher(low, 1)(starts, ends)),
                        as_long(ids[block.first + owner]),
                        as_long(keys[block.first + owner]),
                        pa.array(number.astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc", "text_key", "line"],
                )

    return run


def _rows(kind: int, rows: list[np.ndarray], n_docs: np.ndarray | int = 0) -> pa.RecordBatch:
    n = len(rows[0])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32))]
        + [pa.array(x) for x in rows[:4]]
        + [pa.array(rows[4].astype(np.int32)), pa.array(np.broadcast_to(np.int64(n_docs), n))],
        names=["kind", "h1", "h2", "doc", "text_key", "line", "n_docs"],
    )


def stream_first_occurrences(min_docs: int):
    """Decide the lines of one sorted partition.

    A key opened inside the partition shows its largest document first; its other
    rows wait in memory until ``min_docs`` documents are seen, which bounds the
    buffer to ``min_docs - 1`` documents. The first key may have begun in the
    partition before, and the last may go on in the next: a border row tells what
    was seen of it here, and rows that it can't settle go out as pending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the open key that are not decided yet
        key = top = None  # the open key and its largest document
        seen, first = 0, True  # documents of the open key so far; is it the partition's first key
        last_doc = None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(rows[0]):
                continue
            h1, h2, doc = rows[:3]
            change = np.ones(len(h1), bool)
            change[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            change[0] = key != (h1[0], h2[0])
            new_doc = change.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            new_doc[0] |= doc[0] != last_doc
            cuts = np.flatnonzero(change)
            bounds = np.concatenate([[0], cuts[cuts > 0], [len(h1)]])
            counts = np.add.reduceat(new_doc.astype(np.int64), bounds[:-1])
            tops = doc[bounds[:-1]].copy()
            if not change[0]:
                counts[0] += seen
                tops[0] = top
            elif key is not None:  # the open key ended with the batch before
                if first:
                    yield _rows(BORDER, [np.array([x]) for x in (*key, top, 0, 0)], seen)
                held, first = None, False
            run_of = np.repeat(np.arange(len(tops)), np.diff(bounds))
            waiting = first  # run 0 is the partition's first key
            closed = np.arange(len(tops)) < len(tops) - 1
            many = counts >= min_docs
            lower = doc < tops[run_of]
            final = lower & many[run_of]
            if waiting:
                final &= run_of > 0
                if (run_of == 0).any():
                    yield _rows(PENDING, [x[run_of == 0] for x in rows])
            yield _rows(FINAL, [x[final] for x in rows])
            if held is not None:
                if many[0]:
                    yield _rows(FINAL, held)
                if many[0] or closed[0]:
                    held = None
            if waiting and closed[0]:
                yield _rows(BORDER, [np.array([x]) for x in (h1[0], h2[0], tops[0], 0, 0)], int(counts[0]))
                first = False
            last = len(tops) - 1
            key, top, seen, last_doc = (h1[-1], h2[-1]), tops[-1], int(counts[-1]), doc[-1]
            if not first and not many[last]:
                own = [x[(run_of == last) & lower] for x in rows]
                held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        if key is not None:
            yield _rows(BORDER, [np.array([x]) for x in (*key, top, 0, 0)], seen)
            if held is not None:
                yield _rows(PENDING, held)

    return run


def keep_bitmap(drop) -> bytes:
    """Little-endian keep bits, zlib-compressed; lines beyond the last bit are kept."""
    bits = np.ones(-(-(int(max(drop)) + 1) // 8) * 8, np.uint8)  # whole bytes, filled up with keeps
    bits[np.asarray(drop, np.int64)] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, text_key, n_dropped, keep``: one row for each document that loses lines.

    A line's key is the line without ASCII white space at both ends and with A-Z
    in lower case. Keys of at least ``min_chars`` code points that stand in at
    least ``min_docs`` documents lose all lines but those of the largest doc_id.

    Nulls: a null text is one empty line; rows with a null doc_id count as one
    document smaller than all others. Rows that share a doc_id count as one
    document. Ties cannot occur, for all lines of the largest document stay. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    texts = keyed_texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text_key", "text")
    lines = stored(texts.mapInArrow(line_keys(min_chars), LINES), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "line")
    marks = stored(dealt.mapInArrow(stream_first_occurrences(min_docs), MARKS), "line-marks")
    # At most two rows for each range partition.
    border = (
        marks.where(F.col("kind") == BORDER)
        .groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("all_docs"), F.max("doc").alias("top"))
        .where(F.col("all_docs") >= min_docs)
    )
    pending = (
        marks.where(F.col("kind") == PENDING)
        .join(F.broadcast(border), ["h1", "h2"])
        .where(F.col("doc") < F.col("top"))
    )

    def bitmaps(lines: pd.Series) -> pd.Series:
        return lines.map(keep_bitmap)

    as_bitmap = F.pandas_udf(bitmaps, T.BinaryType())
    keys = ["doc", "text_key", "line"]
    dropped = marks.where(F.col("kind") == FINAL).select(*keys).unionByName(pending.select(*keys))
    return (
        dropped.groupBy("doc", "text_key")
        .agg(F.collect_set("line").alias("lines"))  # of one document
        .select(
            F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
            "text_key",
            F.size("lines").cast("long").alias("n_dropped"),
            as_bitmap("lines").alias("keep"),
        )
    )


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int]:
    """What is left of a text, and its number of lines before."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    bits = np.append(bits, np.ones(max(0, len(lines) - len(bits)), np.uint8))
    return b"\n".join(x for x, b in zip(lines, bits) if b), len(lines)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Each row of ``docs`` with its bitmap as ``keep`` (null: nothing is dropped) and ``n_dropped``."""
    bitmaps = bitmaps.hint("shuffle_hash")
    return docs.join(bitmaps, same_row(docs, bitmaps), "left").select(
        *[docs[c] for c in docs.columns], bitmaps["n_dropped"], bitmaps["keep"]
    )


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text``, and ``n_chars`` counted anew if it is there.

    All other columns stay as they are, whatever their names (but for those that
    begin with ``__line_``).
    """
    marks = bitmaps.select(
        F.col("doc_id").alias("__line_doc"), F.col("text_key").alias("__line_text"), F.col("keep").alias("__line_keep")
    ).hint("shuffle_hash")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("__line_doc")) & (F.xxhash64("text") == F.col("__line_text"))

    def without_dropped(texts: pd.Series, keeps: pd.Series) -> pd.Series:
        return texts.combine(keeps, lambda t, k: None if t is None else kept_lines(t.encode(), k)[0].decode())

    left = F.pandas_udf(without_dropped, T.StringType())
    text = F.when(F.col("__line_keep").isNull(), F.col("text")).otherwise(left("text", "__line_keep"))
    out = docs.join(marks, own, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def line_digests(docs: DataFrame, **rule) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""
    joined = with_bitmaps(keyed_texts(docs), line_bitmaps(docs, **rule))

    def run(batches):
        for batch in batches:
            n_lines, shas = [], []
            for text, keep in zip(batch.column("text"), batch.column("keep")):
                raw = text.as_buffer()
                left, n = kept_lines(raw.to_pybytes() if raw is not None else b"", keep.as_py())
                n_lines.append(n)
                shas.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_lines, pa.int64()), batch.column("n_dropped"), pa.array(shas, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return (
        joined.select("doc_id", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "text", "keep")
        .mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    )
