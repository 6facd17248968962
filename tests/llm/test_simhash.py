"""SimHash near-duplicates against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from feedloom.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(pairs_of, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs_of:
        u, v = sorted((find(a), find(b)))
        parent[v] = u
    return {n: find(n) for n in nodes}


def close(values, most=3):
    values = np.array(sorted(values), np.uint64)
    for i, x in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ x) <= most):
            yield int(x), int(values[i + 1 + j])


def brute(rows):
    own = [(d, fingerprint(t)) for d, t in rows]
    pairs = list(close({f for d, f in own if d is not None}))
    docs = {d for d, _ in own if d is not None}
    linked = [(("f", a), ("f", b)) for a, b in pairs] + [(("d", d), ("f", f)) for d, f in own if d is not None]
    find = reach(linked, {("d", d) for d in docs} | {("f", f) for _, f in own})
    least = {}
    for d in sorted(docs, reverse=True):
        least[find["d", d]] = d
    return sorted((str(d), f"{f:016x}", d if d is None else least[find["d", d]]) for d, f in own)


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def test_simhash(spark, docs, rows, empty):
    want = brute(rows)
    assert sum(str(c) != d for d, _, c in want) > 20
    assert got(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_null_and_repeated_ids(spark):
    some = [(None, "a b c"), (4, "a b c"), (4, "x y z w"), (9, "x y z w"), (7, None), (8, " \n"), (3, ""), (None, None), (11, "one two")]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert got(simhash.near_duplicates(df)) == brute(some)


def test_long_text_in_steps(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(150_000))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short one")], "doc_id long, text string")
    assert got(simhash.near_duplicates(df)) == brute([(1, text), (2, text + " more"), (3, "short one")])


@pytest.mark.parametrize("code", simhash.CODES, ids=lambda c: "-".join(str(b[0]) for b in c))
def test_every_code_finds_every_link(code):
    rng = np.random.default_rng(len(code))
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values = set()
    for c in centres.tolist():
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            values.add(c ^ sum(1 << int(b) for b in flips))
    values = np.array(sorted(values), np.uint64)
    cells, homes, rows = [], [], []
    for at, anchors, home in simhash.replicas(values, code):
        for is_home in (True, False) if home else (False,):
            cells.append(anchors), homes.append(np.full(len(at), is_home)), rows.append(values[at])
    cells, homes, rows = map(np.concatenate, (cells, homes, rows))
    assert abs(len(cells) / len(values) - 1 - simhash.mean_replicas(code)) < 0.2 * simhash.mean_replicas(code)
    order = np.lexsort((~homes, cells))
    u, v = simhash.links_of(cells[order], homes[order], rows[order])
    nodes = values.tolist()
    assert reach(zip(u.tolist(), v.tolist()), nodes) == reach(close(values), nodes)


def test_crowded_anchor_is_split(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 7)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(300)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fingerprint long")
    pairs = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.close_fingerprints(df).collect()]
    assert reach(pairs, values) == reach(close(values), values)


def test_perfect_codes():
    for block in (simhash.GOLAY, simhash.HAMMING_15, simhash.HAMMING_7):
        assert (simhash.block_code(*block).count[0] == 1).all()


def test_code_follows_the_number_of_fingerprints():
    sizes = [len(simhash.choose_code(n)) for n in (10, 10**6, 10**8, 10**11)]
    assert sizes == sorted(sizes) and sizes[0] == 1 and sizes[-1] == 3
