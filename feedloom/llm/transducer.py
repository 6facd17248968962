"""Minimal acyclic transducers: sorted words to their lexicographic ordinals.

States that accept the same endings are one state, built while the words arrive in
order (Daciuk et al. 2000). An edge carries the number of words that sort before
its own below the same state, so the sum along a word's path is its ordinal.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np


class Builder:
    """Add words in byte order, each once; ``finish`` gives the transducer."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.words = array("q")  # words below each frozen state
        self.final = bytearray()
        self.keys, self.targets, self.adds = array("q"), array("q"), array("q")
        self.path: list[list] = [[False, bytearray(), []]]  # open states: final, bytes, frozen targets
        self.last = b""
        self.n = 0

    def add(self, word: bytes) -> None:
        shared = 0
        for a, b in zip(word, self.last):
            if a != b:
                break
            shared += 1
        self._close(shared)
        for byte in word[shared:]:
            self.path[-1][1].append(byte)
            self.path.append([False, bytearray(), []])
        self.path[-1][0] = True
        self.last = word
        self.n += 1

    def _close(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            state = self._freeze(*self.path.pop())
            self.path[-1][2].append(state)

    def _freeze(self, final: bool, labels: bytearray, targets: list[int]) -> int:
        key = (final, bytes(labels), *targets)
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.final)
            below = int(final)
            for byte, target in zip(labels, targets):
                self.keys.append(state << 8 | byte)
                self.targets.append(target)
                self.adds.append(below)
                below += self.words[target]
            self.final.append(final)
            self.words.append(below)
        return state

    @property
    def n_edges(self) -> int:
        return len(self.keys)

    def finish(self) -> bytes:
        """The transducer as bytes: counts, then edge keys, targets and ordinals, then final flags; the root is the last state."""
        self._close(0)
        final, labels, targets = self.path.pop()
        self.known.clear()  # the root is a state of its own
        self._freeze(final, labels, targets)
        head = array("q", [len(self.final), len(self.keys)])
        return b"".join([head.tobytes(), self.keys.tobytes(), self.targets.tobytes(), self.adds.tobytes(), bytes(self.final)])


def build(words: Iterable[bytes]) -> bytes:
    builder = Builder()
    for word in words:
        builder.add(word)
    return builder.finish()


def read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edge keys (state * 256 + byte), targets, ordinals, and final flags."""
    n_states, n_edges = np.frombuffer(data, np.int64, 2)
    edges = np.frombuffer(data, np.int64, 3 * n_edges, 16).reshape(3, -1)
    return edges[0], edges[1], edges[2], np.frombuffer(data, np.uint8, n_states, 16 + 24 * int(n_edges)).astype(bool)


def words_of(data: bytes) -> Iterator[bytes]:
    """All words in order, that is by ordinal."""
    keys, targets, _, final = read(data)
    order = np.argsort(keys, kind="stable")
    begin = np.searchsorted(keys[order] >> 8, np.arange(len(final) + 1)).tolist()
    labels, targets = (keys[order] & 255).tolist(), targets[order].tolist()
    root = len(final) - 1
    word = bytearray()
    if final[root]:
        yield b""
    open_edges = [[begin[root], begin[root + 1]]]
    while open_edges:
        here = open_edges[-1]
        if here[0] == here[1]:
            open_edges.pop()
            del word[-1:]
            continue
        edge = here[0]
        here[0] += 1
        word.append(labels[edge])
        state = targets[edge]
        if final[state]:
            yield bytes(word)
        open_edges.append([begin[state], begin[state + 1]])


def prefix_key(word: bytes) -> int:
    """The first eight bytes as a number that orders as the words do."""
    return int.from_bytes(word[:8].ljust(8, b"\0"), "big")


class Walker:
    """Several transducers in one hash table of edges; many words walk through it at once.

    Each transducer holds a range of one vocabulary's words. ``parts`` lists vocabulary,
    prefix key of the first word, ordinal of the first word and bytes of a transducer,
    in order of vocabulary and range.
    """

    LANES = 1 << 17

    def __init__(self, parts: list[tuple[int, int, int, bytes]]):
        keys, targets, adds, final, self.roots = [], [], [], [], []
        n_states = 0
        for _, _, _, data in parts:
            k, t, a, f = read(data)
            keys.append(k + (n_states << 8))
            targets.append(t + n_states)
            adds.append(a)
            final.append(f)
            n_states += len(f)
            self.roots.append(n_states - 1)
        self.roots = np.array(self.roots, np.int64)
        self.base = np.array([p[2] for p in parts], np.int64)
        self.bounds = np.array([p[1] for p in parts], np.uint64)
        self.ranges: dict[int, tuple[int, int]] = {}
        for i, part in enumerate(parts):
            self.ranges[part[0]] = (self.ranges.get(part[0], (i,))[0], i + 1)
        self.final = np.concatenate([*final, np.zeros(0, bool)])
        self._table(*(np.concatenate([*x, np.zeros(0, np.int64)]) for x in (keys, targets, adds)))

    def _table(self, keys: np.ndarray, targets: np.ndarray, adds: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.targets, self.adds = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = keys[todo[free]]  # one of those that want the same place
            put = self.keys[slot] == keys[todo]
            self.targets[slot[put]], self.adds[slot[put]] = targets[todo[put]], adds[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: int) -> np.ndarray:
        """The ordinal of each byte range of ``data`` in the vocabulary, -1 for strange words."""
        out = np.full(len(starts), -1, np.int64)
        low, high = self.ranges.get(vocabulary, (0, 0))
        for i in range(0, len(starts) if low < high else 0, self.LANES):
            self._lanes(data, starts[i : i + self.LANES], ends[i : i + self.LANES], low, high, out[i : i + self.LANES])
        return out

    def _lanes(self, data, starts, ends, low: int, high: int, out: np.ndarray) -> None:
        if high - low == 1:
            self._walk(data, starts, ends, np.full(len(starts), low), np.arange(len(starts)), out)
            return
        prefix = np.zeros(len(starts), np.uint64)
        for k in range(8):
            at = starts + k
            byte = np.where(at < ends, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
            prefix = prefix << np.uint64(8) | byte
        bounds = self.bounds[low:high]
        first = np.searchsorted(bounds, prefix, side="left") - 1
        last = np.searchsorted(bounds, prefix, side="right") - 1
        first = np.maximum(first, 0)
        while True:  # a word may lie in any of the ranges that begin with its prefix
            lanes = np.flatnonzero((out < 0) & (first <= last))
            if not len(lanes):
                break
            self._walk(data, starts[lanes], ends[lanes], first[lanes] + low, lanes, out)
            first[lanes] += 1

    def _walk(self, data, at, ends, part, lanes, out) -> None:
        state, total = self.roots[part], self.base[part].copy()
        at = at.copy()
        while len(lanes):
            key = state << 8 | data[at]
            slot = self._slot(key)
            found = self.keys[slot]
            wrong = np.flatnonzero((found != key) & (found != -1))
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & self.mask
                found[wrong] = self.keys[slot[wrong]]
                wrong = wrong[(found[wrong] != key[wrong]) & (found[wrong] != -1)]
            go = np.flatnonzero(found == key)
            slot, at, ends, lanes = slot[go], at[go] + 1, ends[go], lanes[go]
            state, total = self.targets[slot], total[go] + self.adds[slot]
            done = at == ends
            if done.any():
                whole = done & self.final[state]
                out[lanes[whole]] = total[whole]
                go = np.flatnonzero(~done)
                at, ends, lanes, state, total = at[go], ends[go], lanes[go], state[go], total[go]
