"""Alignment of two tokenizers over the same texts by vectorised merging in lockstep.

Both tokenizers' tokens are byte ranges of the same bytes, so their ends are merged.
All stretches of a batch's documents are merged at once: a state vector holds a
pointer into the A tokens and one into the B tokens for each stretch, every step
moves those whose token ends first, and where both end together it emits a link and
a cut. Where a stretch begins, both pointers follow from its offset alone, so long
documents are several stretches and the number of steps stays small. Finished
stretches leave the vector.

Tokens never cross a single space between two other characters, so texts are cut
there and each batch tokenises its distinct pieces once.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import stored
from feedloom.llm.text_arrays import blocks

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BATCH_BYTES = 1 << 22  # of texts whose pieces are tokenised together
PART_BYTES = 1 << 20  # of pieces that are merged together
STRETCH = 256  # bytes
FLUSH = 1 << 20  # link counts that a task holds before it hands them on
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
GROUPS = "doc_id long, group long, begin long, stop long, a_ids array<int>, b_ids array<int>"

# Bytes beside a space that may belong to other white space: control characters, and the first
# bytes of U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000.
MAY_BE_SPACE = np.zeros(256, bool)
MAY_BE_SPACE[:33] = MAY_BE_SPACE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def paths(a: str | None = None, b: str | None = None) -> tuple[str, str]:
    if a and b:
        return a, b
    import public_tokenizers

    return a or public_tokenizers.path(A_FILE), b or public_tokenizers.path(B_FILE)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def _packed(tokens: list[list[int]], values: list[bytes], n: int, units: list[bytes]):
    """Ids of all units in a row, where each unit's begin, how many, and which units they spell."""
    count = np.fromiter(map(len, tokens), np.int64, n)
    ids = np.fromiter(chain.from_iterable(tokens), np.int64, int(count.sum()))
    right = np.fromiter((b"".join([values[i] for i in t]) == u for t, u in zip(tokens, units)), bool, n)
    return ids, np.cumsum(count) - count, count, right


class Tokenizers:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second vocabulary crosses words")
        self.a_size, self.b_size = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        # Decimal digits of each id with room for a separator.
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.width = np.char.str_len(np.arange(most).astype(str)) + 1
        text = np.arange(most).astype(f"S{self.width.max()}")
        self.digits = text.view(np.uint8).reshape(most, -1)

    def encode(self, units: list[bytes]):
        """Tokens of units that begin with a space, by A as they are, by B without that space."""
        texts = [u.decode(errors="replace") for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return _packed(a, self.a_bytes, len(units), units), _packed(b, self.b_bytes, len(units), units)


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)  # of fixed size


def units_of(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a space before each text, the units' offsets in them, and their documents.

    A unit begins with a space, the one that a text is given or a single one between
    characters that are no white space.
    """
    some = np.flatnonzero(block.offsets[1:] > block.offsets[:-1])
    data = np.insert(block.data, block.offsets[some], 32)
    starts = block.offsets[some] + np.arange(len(some))
    if not len(data):
        return data, np.zeros(1, np.int64), some
    far = MAY_BE_SPACE.copy()
    far[:128] = False  # as the first of several bytes
    cut = np.zeros(len(data), bool)
    cut[1:-1] = (data[1:-1] == 32) & ~MAY_BE_SPACE[data[2:]] & ~(MAY_BE_SPACE[data[:-2]] & (data[:-2] < 128))
    cut[2:] &= ~(data[:-2] == 0xC2)
    cut[3:] &= ~far[data[:-3]]
    cut[starts[1:] - 1] = False  # a text's last byte has nothing after it
    cut[np.minimum(starts + 1, len(data) - 1)] = False  # nor has its first byte anything before it
    cut[starts] = True
    begins = np.flatnonzero(cut)
    return data, np.append(begins, len(data)), some[np.searchsorted(starts, begins, side="right") - 1]


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of begin[i], begin[i] + 1, ... in a row, count[i] of them."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - begin, count)


def merge(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the A and of the B tokens that end together; the k-th ones of both are linked.

    ``starts`` are offsets where stretches begin, the first one 0; any will do.
    """
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    stops = np.append(starts[1:], a_ends[-1] if len(a_ends) else 0)
    # Pointers of a stretch: the first tokens that end after its begin, and after its end.
    state = np.stack([np.searchsorted(e, starts, side="right") for e in (a_ends, b_ends)])
    last = np.stack([np.searchsorted(e, stops, side="right") for e in (a_ends, b_ends)])
    never = np.iinfo(np.int64).max
    a_ends, b_ends = np.append(a_ends, never), np.append(b_ends, never)
    while state.shape[1]:
        todo = (state < last).any(0)
        if not todo.all():
            state, last = state[:, todo], last[:, todo]  # finished ones leave
        a, b = a_ends[state[0]], b_ends[state[1]]
        both = a == b
        a_cut[state[0][both]] = True
        b_cut[state[1][both]] = True
        state += np.stack([a <= b, b <= a])
    return a_cut[: len(a_ends) - 1], b_cut[: len(b_ends) - 1]


class Part:
    """Merged tokens of consecutive units: ids, which ones end a group, and the groups' documents."""

    def __init__(self, own: Tokenizers, a: np.ndarray, b: np.ndarray, starts: np.ndarray, owner: np.ndarray):
        self.own, self.a, self.b = own, a, b
        a_ends, b_ends = np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])
        # Stretches begin with documents and then every STRETCH bytes.
        n = -(-np.diff(np.append(starts, a_ends[-1] if len(a) else 0)) // STRETCH)
        at = np.repeat(starts, n) + STRETCH * _ragged(np.zeros(len(n), np.int64), n)
        self.a_cut, self.b_cut = merge(a_ends, b_ends, at)
        self.a_last, self.b_last = np.flatnonzero(self.a_cut), np.flatnonzero(self.b_cut)
        self.ends = a_ends[self.a_last]
        self.doc = owner[np.searchsorted(starts, self.ends, side="left") - 1]

    def groups_text(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of all groups, and where each group ends."""
        own, n = self.own, len(self.a) + len(self.b)
        b_first = np.append(0, self.b_last + 1)[np.cumsum(self.a_cut) - self.a_cut]
        a_next = (self.a_last + 1)[np.cumsum(self.b_cut) - self.b_cut]
        a_place, b_place = np.arange(len(self.a)) + b_first, np.arange(len(self.b)) + a_next
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[a_place], ids[b_place] = self.a, self.b
        mark[a_place[self.a_cut]], mark[b_place[self.b_cut]] = ord("|"), ord(";")
        width = own.width[ids]
        cells = own.digits[ids]
        cells[np.arange(n), width - 1] = mark
        flat = cells[np.arange(cells.shape[1]) < width[:, None]]
        return flat, np.cumsum(width)[b_place[self.b_last]]


def _parts(batch: pa.RecordBatch, own: Tokenizers) -> Iterator[tuple[int, int, Part | None]]:
    """Documents of a batch in blocks: first document, how many, and their parts; None closes a block."""
    for block in blocks(batch.column("text"), BATCH_BYTES):
        data, offsets, owner = units_of(block)
        if len(owner):
            units = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(owner), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
            ).dictionary_encode()
            code = units.indices.to_numpy().astype(np.int64)
            (a, a_at, a_n, a_right), (b, b_at, b_n, b_right) = own.encode(units.dictionary.to_pylist())
            bad = np.zeros(block.n_docs, bool)
            bad[owner[~(a_right & b_right)[code]]] = True
            good = np.flatnonzero(~bad[owner])
            code, owner, size = code[good], owner[good], np.diff(offsets)[good]
            total = np.cumsum(size)
            i = 0
            while i < len(code):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PART_BYTES, side="right")))
                u = code[i:j]
                docs, first = np.unique(owner[i:j], return_index=True)
                starts = (np.cumsum(size[i:j]) - size[i:j])[first]
                yield block.first, block.n_docs, Part(own, a[_ragged(a_at[u], a_n[u])], b[_ragged(b_at[u], b_n[u])], starts, docs)
                i = j
        yield block.first, block.n_docs, None


def _digest_rows(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(a_path, b_path)
        size = len(own.b_bytes)
        for batch in batches:
            counts = links = sums = None
            for first, n, part in _parts(batch, own):
                if counts is None:
                    counts, links, sums = np.zeros((3, n), np.int64), [], [None] * n
                if part is not None:
                    edge = np.searchsorted(part.doc, np.arange(n + 1))
                    counts[2] += np.diff(edge)
                    for row, last in (0, part.a_last), (1, part.b_last):
                        ends = np.append(0, last + 1)[edge]
                        counts[row] += np.diff(ends)
                    pair = part.a[part.a_last] * size + part.b[part.b_last]
                    order = np.lexsort((pair, part.doc))
                    links.append(_summed(part.doc[order], pair[order], np.ones(len(pair), np.int64)))
                    text, ends = part.groups_text()
                    ends = np.append(0, ends)[edge]
                    text = text.tobytes()
                    for d in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                        if sums[d] is None:
                            sums[d] = hashlib.sha256()
                        else:
                            sums[d].update(b";")
                        sums[d].update(text[ends[d] : ends[d + 1] - 1])
                    continue
                doc, pair, times = (np.concatenate([x[k] for x in links] or [np.zeros(0, np.int64)]) for k in range(3))
                if len(links) > 1:
                    order = np.lexsort((pair, doc))
                    doc, pair, times = _summed(doc[order], pair[order], times[order])
                edge = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n),
                        *(pa.array(c) for c in counts),
                        pa.array([s.hexdigest() if s else "" for s in sums], pa.string()),
                        pa.ListArray.from_arrays(edge, pa.array(pair)),
                        pa.ListArray.from_arrays(edge, pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
                )
                counts = None

    return run


def _summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted rows with equal document and pair in one."""
    if not len(doc):
        return doc, pair, times
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])
    return doc[new], pair[new], np.add.reduceat(times, new)


def _group_rows(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(a_path, b_path)
        for batch in batches:
            done = None
            for first, n, part in _parts(batch, own):
                if part is None:
                    done = None
                    continue
                done = np.zeros((2, n), np.int64) if done is None else done  # groups and bytes of earlier parts
                edge = np.searchsorted(part.doc, np.arange(n + 1))
                held = np.diff(edge)
                base = np.append(0, part.ends)[edge[:-1]]
                number = np.arange(len(part.doc)) - edge[part.doc] + done[0][part.doc]
                stop = part.ends - base[part.doc] + done[1][part.doc]
                begin = np.append(0, stop[:-1])
                fresh = edge[:-1][held > 0]
                begin[fresh] = done[1][held > 0]
                done += np.stack([held, np.append(0, part.ends)[edge[1:]] - base])
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.append(0, last + 1).astype(np.int32)), pa.array(ids.astype(np.int32)))
                    for last, ids in ((part.a_last, part.a), (part.b_last, part.b))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n).take(pa.array(part.doc)), pa.array(number), pa.array(begin), pa.array(stop), *lists],
                    names=["doc_id", "group", "begin", "stop", "a_ids", "b_ids"],
                )

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def aligned_groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``doc_id, group, begin, stop, a_ids, b_ids``: the smallest ranges of bytes that both tokenizers end.

    ``begin`` and ``stop`` count the bytes of space + text; ``group`` counts from 0.
    Texts without tokens have no rows; see ``alignment_digests``.
    """
    return _rows(docs).mapInArrow(_group_rows(*paths(a, b)), GROUPS)


def most_pairs(own: Tokenizers) -> int:
    """How many id pairs can end together: one's bytes are the end of the other's."""
    a, b = ({}, {})
    for known, values in (a, own.a_bytes), (b, own.b_bytes):
        for value in values:
            known[value] = known.get(value, 0) + 1
    shorter = sum(n * b.get(v[k:], 0) for v, n in a.items() for k in range(len(v)))
    return shorter + sum(n * a.get(v[k:], 0) for v, n in b.items() for k in range(1, len(v)))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        pair, times = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(pair, kind="stable")
        _, pair, times = _summed(np.zeros(len(pair), np.int8), pair[order], times[order])
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times)], names=["pair", "n"])

    for batch in batches:
        held.append((batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)))
        size += len(held[-1][0])
        if size > FLUSH:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def _count_rows(known):
    """Each document's links weighed with the corpus-wide counts of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        for batch in batches:
            ends = np.append(0, np.cumsum(batch.column("pairs").value_lengths().to_numpy()))
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(pairs, batch.column("pairs").flatten().to_numpy())
            sums = []
            for value in (times, times * best[at], times * counts[at]):
                sums.append(pa.array(np.diff(np.append(0, np.cumsum(value))[ends])))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names[:4]), *sums, batch.column(names[-1])], names=names
            )

    return run


def alignment_digests(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A encodes space + text, B encodes the text and adds that space itself; strings of
    special tokens are plain text. A link joins an A and a B token that end at the same
    byte. An id pair's count is its number of links in all rows; ``n_best`` counts
    links whose pair is the most frequent of its B id (ties included), ``count_sum``
    adds up the counts of a row's links.

    Nulls: a null or empty text, or one that the tokens of A or of B do not spell byte
    by byte, has no tokens: zeros, and '' instead of a hash. A null doc_id stays null.
    Repeated rows are counted as often as they occur. An empty table gives no rows.
    Other columns are ignored.

    The counts are sent to the tasks. Pairs that end together are suffixes of each
    other, so the two vocabularies bound their number (``most_pairs``), not the data.
    """
    spark = docs.sparkSession
    aligned = stored(_rows(docs).mapInArrow(_digest_rows(*paths(a, b)), DIGESTS), "aligned")
    counted = aligned.select("pairs", "times").mapInArrow(_pair_sums, "pair long, n long")
    table = counted.groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    pairs, counts = (table.column(c).to_numpy() for c in ("pair", "n"))
    b_ids = pairs % len(tokenizers(*paths(a, b)).b_bytes)
    top = np.zeros(int(b_ids.max(initial=-1)) + 1, np.int64)
    np.maximum.at(top, b_ids, counts)
    known = spark.sparkContext.broadcast((pairs, counts, counts == top[b_ids]))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.mapInArrow(_count_rows(known), schema)
