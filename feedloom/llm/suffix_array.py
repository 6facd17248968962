"""Suffix arrays and common prefixes in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The sorted suffixes of a byte array.

    Larsson-Sadakane refinement: suffixes are sorted by their first eight bytes,
    then every group that is still tied is sorted by the rank that its members
    have a prefix length further on, which doubles the length sorted by. Groups of
    one are never touched again.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix that ends early sorts before one that goes on with a zero byte: bytes count from 1
    # in nine bits, seven of them in a word.
    length = 7
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(length, np.uint64)])
    head = np.zeros(n, np.uint64)
    for k in range(length):
        head = (head << np.uint64(9)) | padded[k : n + k]
    order = np.argsort(head, kind="stable").astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = head[order[1:]] != head[order[:-1]]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1  # beyond the end
    starts = np.flatnonzero(new).astype(np.int32)
    group = np.repeat(starts, np.diff(np.append(starts, n)))  # a group is named by its first place
    rank[order] = group
    while True:
        tied = ~new
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        own = order[places]
        ahead = rank[np.minimum(own + length, n)]
        sub = np.argsort((group[places].astype(np.int64) << 32) + ahead)  # places stay under 2 ** 31
        order[places] = own[sub]
        ahead = ahead[sub]
        split = np.zeros(len(places), bool)
        split[1:] = ahead[1:] != ahead[:-1]
        new[places[split]] = True
        starts = np.flatnonzero(new).astype(np.int32)
        group = np.repeat(starts, np.diff(np.append(starts, n)))
        rank[order[places]] = group[places]
        length *= 2
    return order.astype(np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Bytes, up to ``limit``, that each of the sorted suffixes ``order`` shares with the one before it.

    Neighbours are compared eight bytes at a time; those that are alike so far go on.
    """
    n = len(text)
    shared = np.zeros(len(order), np.int64)
    # Eight bytes from each place on, the first one lowest, so that they are compared at once.
    padded = np.concatenate([text, np.zeros(7, text.dtype)]).astype(np.uint64)
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight |= padded[k : n + k] << np.uint64(8 * k)
    going, a, b = np.arange(1, len(order)), order[1:], order[:-1]
    for held in range(0, limit, 8):
        if not len(going):
            break
        room = np.minimum(limit - held, n - np.maximum(a, b))
        apart = eight[a] ^ eight[b]
        alike = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3  # 8 if none is
        shared[going] += np.minimum(alike, room)
        on = np.flatnonzero((alike == 8) & (room > 8))
        going, a, b = going[on], a[on] + 8, b[on] + 8
    return shared
