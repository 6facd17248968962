"""Concatenate-and-cut packing of tokenised documents into fixed windows.

Pass one tokenises, stores the ids and the running offset inside each partition.
The partition totals, one number for each partition, are summed up into global
offsets; pass two cuts every document at the window borders by arithmetic alone,
so no row is shuffled. Only the last sequence can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import stored
from feedloom.llm.text_arrays import TO_LOWER, blocks

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
TOKENS = "doc_id long, part int, local_start long, doc_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Byte classes between which the vocabulary's own splitting always cuts: letters, digits (each for
# itself) and other marks. 0 never cuts: quotes (contractions), the brackets of special tokens, and
# most bytes beyond ASCII.
KINDS = np.zeros(256, np.uint8)
KINDS[65:91] = KINDS[97:123] = 1
KINDS[48:58] = 2
KINDS[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = 3


def word_pieces(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start, end and document of the pieces; which of them are of one kind."""
    data = TO_LOWER[block.data]
    kinds = KINDS[data]
    # Letters U+00C0 to U+00FF, two bytes each; the signs for times and division are not letters.
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kinds[lead] = kinds[lead + 1] = 1
    upper = lead[data[lead + 1] < 0x9F] + 1
    data[upper] += 0x20
    starts, ends, _ = block.words(data)
    cuts = np.flatnonzero(((kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)) & (kinds[1:] > 0) & (kinds[:-1] > 0)) + 1
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    some = starts < ends
    starts, ends = starts[some], ends[some]
    other = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kinds == 0, out=other[1:])
    return data, starts, ends, block.owner(starts), other[starts] == other[ends]


class WordTokenizer:
    """Ids of whole texts through a bounded memory of the words met so far.

    The vocabulary drops white space, lower-cases and cuts at letters, digits and
    marks before it merges anything, so the ids of a text are those of its pieces
    in a row. Pieces are looked up by a 64-bit hash; the tokenizer itself sees each
    new piece once: plain ones (letters up to U+00FF, one digit, marks) go straight
    to its merges, all others through the whole tokenizer. Beyond ``most`` bytes the
    memory starts anew.
    """

    def __init__(self, path: str, most: int = 24 << 20):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, text: str, plain: bool) -> list[int]:
        if plain:
            return [t.id for t in self.merges.tokenize(text if text.isascii() else text.translate(self.as_bytes))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, pieces: list[tuple[str, bool]]) -> None:
        flat: list[int] = []
        ends = []
        for text, plain in pieces:
            flat += self._ids(text, plain)
            ends.append(len(flat))
        count = np.diff(np.array(ends), prepend=0)
        begin = len(self.ids) + np.array(ends) - count
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, begin)
        self.count = np.insert(self.count, at, count)

    def encode(self, block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and how many each document has."""
        data, starts, ends, owner, plain = word_pieces(block)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(block.n_docs, np.int64)
        # The other pieces keep their letters as they are: special tokens are found before lowering.
        hashes = np.where(plain, block.hasher(data)(starts, ends), block.hasher(None, 1)(starts, ends))
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            if sum(x.nbytes for x in (self.keys, self.begin, self.count, self.ids)) + 40 * len(new) > self.most:
                self._forget()
                new = np.arange(len(keys))
            low, raw = data.tobytes(), block.data.tobytes()

            def pieces(some: np.ndarray) -> list[tuple[str, bool]]:
                rows = first[some]
                return [
                    ((low if p else raw)[i:j].decode(), p)
                    for i, j, p in zip(starts[rows].tolist(), ends[rows].tolist(), plain[rows].tolist())
                ]

            self._learn(keys[new], pieces(new))
            at = np.searchsorted(self.keys, keys)
        count = self.count[at][which]
        begin = self.begin[at][which]
        total = np.cumsum(count)
        place = np.arange(int(total[-1])) + np.repeat(begin - (total - count), count)
        return self.ids[place], np.bincount(owner, count, block.n_docs).astype(np.int64)


_MODELS: dict[str, WordTokenizer] = {}  # one for each worker process


def tokenise(path: str, end_id: int = END_ID):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            if path not in _MODELS:
                _MODELS[path] = WordTokenizer(path)
            for block in blocks(batch.column("text")):
                ids, counts = _MODELS[path].encode(block)
                stops = np.cumsum(counts)
                with_end = np.insert(ids, stops, end_id).astype("<u4")
                counts = counts + 1
                stops = np.cumsum(counts)
                local = start + stops - counts
                start += int(stops[-1])
                cells = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], stops * 4]).astype(np.int64)), pa.py_buffer(with_end)]
                )
                own = batch.column("doc_id").slice(block.first, block.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.full(len(counts), part, np.int32)), pa.array(local), pa.array(counts), cells.cast(pa.binary())],
                    names=["doc_id", "part", "local_start", "doc_tokens", "ids"],
                )

    return run


def token_table(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, local_start, doc_tokens, ids``: the stored result of pass one.

    ``ids`` holds little-endian unsigned 32-bit values, ``end_id`` last. A null or
    empty text has the end id alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(tokenise(path or vocabulary_path(), end_id), TOKENS), "tokens")


def partition_offsets(tokens: DataFrame) -> dict[int, int]:
    """Tokens before each partition: one number for each partition comes to the driver."""
    totals = sorted(
        tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect(), key=lambda r: r["part"]
    )
    sums = [0, *accumulate(r["n"] for r in totals)]
    return {r["part"]: s for r, s in zip(totals, sums)}


def cut(base: dict[int, int], window: int, with_ids: bool = False):
    """Cut the documents of a batch at multiples of ``window``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "part", "local_start", "doc_tokens")]
            for (doc, part, local, n), cell in zip(zip(*columns), batch.column("ids")):
                at, ids = base[part] + local, cell.as_buffer()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(piece), n, sequence, offset)
                    rows.append((*row, piece.to_pybytes()) if with_ids else row)
                    start += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            cells = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cells, kinds)], names=names + ["ids"] * with_ids
            )

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document longer than a window is cut into several pieces; every id lies in
    one piece and the pieces of a sequence fill it without a gap from 0. Nulls: a
    null text is empty and still has its end id; a null doc_id stays null. Repeated
    rows are packed as often as they occur. An empty table gives no rows. Other
    columns are ignored.
    """
    tokens = token_table(docs, path, end_id)
    return tokens.mapInArrow(cut(partition_offsets(tokens), window), PIECES)


SEQUENCES = "sequence_id long, offset long, length long, ids binary"


def join_pieces(window: int):
    """Whole windows of a stretch of pieces, and boundary records for the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, begin, end, parts = None, 0, 0, []
        for batch in batches:
            rows = []
            for s, o, n, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "length", "ids"))):
                if (s, o) != (sequence, end):
                    if parts:
                        rows.append((sequence, begin, end - begin, b"".join(parts)))
                    sequence, begin, end, parts = s, o, o, []
                parts.append(ids)
                end += n
            yield _sequences(rows)
        if parts:
            yield _sequences([(sequence, begin, end - begin, b"".join(parts))])

    return run


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    cells = zip(*rows) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(cells, kinds)], names=["sequence_id", "offset", "length", "ids"]
    )


def packed_sequences(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``sequence_id, ids``: the sequences themselves (little-endian unsigned 32-bit ids).

    Windows that lie in one task are put together there. A window that crosses
    tasks leaves a boundary record in each; only those records are shuffled.
    """
    tokens = token_table(docs, path, end_id)
    pieces = tokens.mapInArrow(cut(partition_offsets(tokens), window, with_ids=True), PIECES + ", ids binary")
    found = stored(pieces.mapInArrow(join_pieces(window), SEQUENCES), "sequences")
    boundary = (
        found.where(F.col("length") < window)
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # of one window
        .select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
    )
    return found.where(F.col("length") == window).select("sequence_id", "ids").unionByName(boundary)
