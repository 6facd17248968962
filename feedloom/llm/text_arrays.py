"""Texts of an Arrow batch as numpy arrays: words, lines and their hashes.

Everything works on the UTF-8 bytes of a block of whole documents, so one numpy
call covers many documents. A hash of a byte range is a polynomial over 2**64
taken from prefix sums and divided by the power of its start, which makes it
independent of the place where the range stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

# Odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LENGTH = np.uint64(0x2545F4914F6CDD1D)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


STEP = 1 << 10


@lru_cache(maxsize=4)
def _powers(root: int) -> tuple[np.ndarray, np.ndarray]:
    """root**0 to root**(STEP - 1), and root**(STEP * k) for as many k: a power is a product of two."""
    small, large = np.full(STEP, root, np.uint64), np.full(STEP, pow(root, STEP, 1 << 64), np.uint64)
    small[0] = large[0] = 1
    return np.cumprod(small, dtype=np.uint64), np.cumprod(large, dtype=np.uint64)


def _power(root: int, at: np.ndarray) -> np.ndarray:
    small, large = _powers(root)
    out = small[at % STEP]
    at = at // STEP
    out *= large[at % STEP]
    if len(at) and at.max() >= STEP:  # texts of over a million bytes
        out *= _power(pow(root, STEP * STEP, 1 << 64), at // STEP)
    return out


def _first_powers(root: int, n: int) -> np.ndarray:
    small, large = _powers(root)
    if n > STEP * STEP:
        return _power(root, np.arange(n))
    return (large[: -(-n // STEP), None] * small).ravel()[:n]


class Block:
    """The bytes of consecutive documents: document i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n_docs = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte-wise flag over each document."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every run of bytes that are not ASCII white space."""
        data = self.data if data is None else data
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none
        space = IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        begins = ~space
        begins[1:] &= space[:-1] | edge[1:-1]
        ends = ~space
        ends[:-1] &= space[1:] | edge[1:-1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, self.owner(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (without the newline) and document of every line; an empty text has one."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        owner = np.concatenate([np.arange(self.n_docs), self.owner(breaks)])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        last = np.append(owner[1:] != owner[:-1], True)
        ends[last] = self.offsets[1:]
        return starts, ends, owner

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, side="right") - 1

    def _sums(self, data: np.ndarray, which: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        weighed = _first_powers(BASES[which], len(data))
        weighed *= data.astype(np.uint64) + np.uint64(1)
        np.cumsum(weighed, dtype=np.uint64, out=sums[1:])
        return sums

    def hasher(self, data: np.ndarray | None = None, which: int = 0):
        """A function giving the hashes of byte ranges of ``data``."""
        data = self.data if data is None else data
        sums, inverse = self._sums(data, which), pow(BASES[which], -1, 1 << 64)

        def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            if not len(starts):
                return np.zeros(0, np.uint64)
            whole = (sums[ends] - sums[starts]) * _power(inverse, starts)
            return mix(whole + (ends - starts).astype(np.uint64) * LENGTH)

        return hashes

    def windows(self, width: int) -> np.ndarray:
        """The hash of every ``width`` bytes in a row, as ``hasher`` gives it."""
        n = len(self.data) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = self._sums(self.data, 0)
        whole = sums[width:] - sums[:n]
        whole *= _first_powers(pow(BASES[0], -1, 1 << 64), n)
        return mix(whole + np.uint64(width * int(LENGTH) & MASK))


def blocks(texts: pa.Array, most: int = 1 << 19) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts of about ``most`` bytes; a null is empty."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.null_count:  # a null may own bytes
        texts = pa.array([x or b"" for x in texts.to_pylist()], pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, len(texts))
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def window_hashes(values: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of ``width`` values that lie in one document."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.zeros(n, np.uint64)
    for k in range(width):
        whole *= np.uint64(BASES[1])
        whole += values[k : n + k]
    places = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return places, mix(whole[places])


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed longs that Spark knows."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())
