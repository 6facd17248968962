"""Cross-tokenizer alignment against whole-text tokenising and a merge by sets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import alignment
from feedloom.llm.text_arrays import blocks


@pytest.fixture(scope="module")
def own():
    return alignment.tokenizers(*alignment.paths())


def whole(own, text):
    """A and B ids of a whole text, both empty where they do not spell it."""
    if not text:
        return [], []
    want = b" " + text.encode()
    a = own.a.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    spelled = b"".join(own.a_bytes[i] for i in a) == want and b"".join(own.b_bytes[i] for i in b) == want
    return (a, b) if spelled else ([], [])


def groups(own, a, b):
    ends_a, ends_b = ([0, *np.cumsum([len(v[i]) for i in ids])] for ids, v in ((a, own.a_bytes), (b, own.b_bytes)))
    cuts = sorted(set(ends_a) & set(ends_b))
    return [(x, y, a[ends_a.index(x) : ends_a.index(y)], b[ends_b.index(x) : ends_b.index(y)]) for x, y in zip(cuts, cuts[1:])]


def brute(own, rows):
    found = [(d, *whole(own, t)) for d, t in rows]
    parted = [groups(own, a, b) for _, a, b in found]
    counts = Counter((g[2][-1], g[3][-1]) for gs in parted for g in gs)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for (d, a, b), gs in zip(found, parted):
        links = [(g[2][-1], g[3][-1]) for g in gs]
        text = ";".join(",".join(map(str, g[2])) + "|" + ",".join(map(str, g[3])) for g in gs)
        sha = hashlib.sha256(text.encode()).hexdigest() if gs else ""
        out.append((str(d), len(a), len(b), len(gs), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n\nb c", "\t x\ty  z", "x▁y z", "<|endoftext|> <s> <unk> </s>", "<0x41> b",
    "can't won't I'll  they're", "  x", "x  y", "x　 y", "x 　y", "   ", "é è ë", "é x", "漢字 かな 한국", "😀 😀😀",
    "\x00 a \x1f b \x7f c", "a\u0085 b", "a ​b", "﻿ x", "naïve façade—“quoted” text…", "1234 56,789.0", "#$% ^&* ()", "ﬁ ½ ²", "\r\n a\r\n",
    "x" * 5000, "ab " * 3000, "w" + " " * 700 + "w", "word   word",
]


def table(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in df.select(*names).collect())


def test_digests(spark, docs, rows, empty, own):
    assert table(alignment.alignment_digests(docs)) == brute(own, rows)
    assert alignment.alignment_digests(empty).count() == 0
    assert alignment.aligned_groups(empty).count() == 0


def test_odd_texts(spark, docs, own):
    some = [(i if i else None, t) for i, t in enumerate(ODD)] + [(7, "a"), (7, "a")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in some], "doc_id long, text string, pairs int, n_a int")
    want = brute(own, some)
    assert sum(w[1] == 0 for w in want) == 3
    assert table(alignment.alignment_digests(df)) == want


def test_groups(spark, docs, rows, own):
    some = [(d, t) for d, t in rows if d < 500] + [(900 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = [tuple(r) for r in alignment.aligned_groups(df).orderBy("doc_id", "group").collect()]
    assert got == [(d, k, *g) for d, t in some for k, g in enumerate(groups(own, *whole(own, t)))]


@pytest.mark.parametrize("stretch", [1, 7, 256])
def test_documents_in_parts(own, rows, monkeypatch, stretch):
    """Small blocks, parts and stretches give the same rows."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "PART_BYTES", 40)
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    some = [(i, t) for i, t in enumerate(ODD)] + [(1000 + i, t) for i, (_, t) in enumerate(rows[:40])]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in some]), pa.array([t for _, t in some])], names=["doc_id", "text"])
    got = [r for b in alignment._digest_rows(*alignment.paths())([batch]) for r in b.to_pylist()]
    want = {w[0]: w for w in brute(own, some)}
    for r in got:
        assert (r["n_a"], r["n_b"], r["n_groups"], sum(r["times"]), r["groups_sha256"]) == tuple(want[str(r["doc_id"])][k] for k in (1, 2, 3, 4, 7))
    cells = [r for b in alignment._group_rows(*alignment.paths())([batch]) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in cells] == [(d, k, *g) for d, t in some for k, g in enumerate(groups(own, *whole(own, t)))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t 　 \x1c.,'1aséßж漢́▁😀") | st.characters(codec="utf-8"), max_size=30), max_size=5))
def test_units_are_tokenised_like_whole_texts(texts):
    import pyarrow as pa

    own = alignment.tokenizers(*alignment.paths())
    for block in blocks(pa.array(texts, pa.string())):
        data, offsets, owner = alignment.units_of(block)
        units = [data[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]
        if not units:
            continue
        (a, a_at, a_n, a_right), (b, b_at, b_n, b_right) = own.encode(units)
        right = a_right & b_right
        for i, text in enumerate(texts):
            mine = np.flatnonzero(owner == i)
            assert b"".join(units[k] for k in mine) == (b" " + text.encode() if text else b"")
            got = [[int(t) for k in mine for t in ids[at[k] : at[k] + n[k]]] for ids, at, n in ((a, a_at, a_n), (b, b_at, b_n))]
            want = whole(own, text)
            assert (tuple(got) if right[mine].all() else ([], [])) == want


def test_counts_are_bounded_by_the_vocabularies(own):
    assert 100_000 < alignment.most_pairs(own) < 1_000_000


def test_long_text(spark, docs, own):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeß") for _ in range(rng.randint(1, 9))) for _ in range(400_000))
    some = [(1, text), (2, "a b"), (3, "x" * 100_000)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = {r[0]: r for r in table(alignment.alignment_digests(df))}
    a, b = whole(own, text)
    assert got["1"][1:3] == (len(a), len(b)) and got["2"][1:3] == tuple(map(len, whole(own, "a b")))
    ends = [np.cumsum([len(v[i]) for i in ids]) for ids, v in ((a, own.a_bytes), (b, own.b_bytes))]
    assert got["1"][3] == len(np.intersect1d(*ends))
