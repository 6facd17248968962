"""The divergence audit and its transducers against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedloom.llm import divergence
from feedloom.llm.text_arrays import blocks
from feedloom.llm.transducer import Walker, build, prefix_key, read, words_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, top=200):
    """rows: text, lang, source."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    held, counts = defaultdict(int), defaultdict(Counter)
    for t, lang, s in rows:
        for w in set(terms(t)):
            held[lang, w] += 1
        counts[lang, s].update(terms(t))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [w for (own, w), n in held.items() if own == lang and n >= 3]
        sources = [s for own, s in counts if own == lang]

        def p(count, kept=kept):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (total + len(kept)) for w in kept}

        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((own[s][w] - own[o][w]) ** 2 // own[o][w] for w in kept), o) for o in sources if o != s]
            best = [((own[s][w] - whole[w]) ** 2 // whole[w], w) for w in kept if counts[lang, s][w] and own[s][w] > whole[w]]
            for part, items in ("pair", pairs), ("term", best):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcÀéßж漢Z") for _ in range(rng.randint(1, 6))) for _ in range(250)]
    rows = []
    for i in range(n):
        words = [rng.choice(pool[: rng.choice((8, 80, 250))]) for _ in range(rng.randint(0, 60))]
        text = rng.choice((" ", "\n", "-1", "_")).join(words)
        lang = rng.choice(("en", "de", None, "", "xx"))
        rows.append((text if rng.random() < 0.97 else None, lang, rng.choice((None, "", "s1", "s2", "S3", "ß"))))
    rows += [("only once here", "lonely", s) for s in ("a", "b")] + [(None, "lonely", None), ("same words", "one", "s")]
    return rows


@pytest.fixture(scope="module")
def table(spark, docs):
    rows = corpus()
    full = [(t, lang, s, i, 3, 4) for i, (t, lang, s) in enumerate(rows)]
    return rows, spark.createDataFrame(full, "text string, lang string, source string, g int, ordinal int, value int").repartition(4)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_audit(table):
    rows, df = table
    want = brute(rows)
    assert {w[2] for w in want} == {"pair", "term"} and any(w[4] == 0 for w in want)
    assert got(divergence.audit(df)) == want
    assert got(divergence.audit(df, top=2)) == brute(rows, 2)


def test_audit_in_many_small_pieces(table, monkeypatch):
    """Many shards a language, passes of one shard, sides of two sources, sums handed on early."""
    rows, df = table
    for name, size in (("SHARD_TERMS", 20), ("PASS_EDGES", 90), ("SIDE", 2), ("CELLS", 9)):
        monkeypatch.setattr(divergence, name, size)
    kept = divergence.vocabulary(df.na.fill("", ["lang"]))
    assert len(kept.passes) > 5
    assert got(divergence.audit(df)) == brute(rows)


def test_ordinals_are_lexicographic(table):
    rows, df = table
    found = defaultdict(list)
    for r in divergence.vocabulary(df.na.fill("", ["lang"])).terms().orderBy("lang", "ordinal").collect():
        assert r.ordinal == len(found[r.lang])
        found[r.lang].append(r.term.encode())
    assert len(found["de"]) > 50 and all(words == sorted(words) for words in found.values())


def test_audit_of_tables_without_terms(spark, docs, empty):
    assert got(divergence.audit(empty)) == []
    rows = [(None, None, None), ("1 2 3", None, "a"), ("word", "", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(divergence.audit(df)) == brute(rows) and len(brute(rows)) == 6


def test_audit_long_texts_and_hot_source(spark, docs):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcd") for _ in range(5)) for _ in range(300)]
    rows = [(" ".join(rng.choice(pool) for _ in range(100_000)) + " " + "x" * 300_000, "en", "hot")] * 3
    rows += [(" ".join(rng.choice(pool) for _ in range(9)), "en", f"s{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got(divergence.audit(df)) == brute(rows)


def test_shares_are_exact():
    counts = np.array([0, 1, 10**15, 3 * 10**14], np.int64)
    total = np.array([10**15 + 7, 3, 10**15 + 9, 4 * 10**15], np.int64)
    want = [1 + 10**9 * (c + 1) // n for c, n in zip(counts.tolist(), total.tolist())]
    assert divergence.shares(counts, total).tolist() == want


def test_transducer():
    rng = random.Random(8)
    words = sorted({bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.randint(1, 12))) for _ in range(900)})
    data = build(words)
    assert list(words_of(data)) == words
    keys, _, _, final = read(data)
    assert len(final) < sum(map(len, words)) / 2
    # Minimal: no two states accept the same endings.
    edges = defaultdict(list)
    for k, t in zip(keys.tolist(), read(data)[1].tolist()):
        edges[k >> 8].append((k & 255, t))
    assert len({(bool(f), tuple(edges[s])) for s, f in enumerate(final)}) == len(final)
    cut = [0, 100, 101, 400, len(words)]
    parts = [(3, prefix_key(words[a]), a, build(words[a:z])) for a, z in zip(cut, cut[1:])]
    parts += [(5, prefix_key(words[0]), 0, build(words[:50]))]
    probe = words + [w + b"a" for w in words] + [w[:-1] or b"zz" for w in words] + [b"\x00", b"\xff" * 40]
    flat = np.frombuffer(b"".join(probe), np.uint8)
    ends = np.cumsum([len(w) for w in probe])
    starts = ends - [len(w) for w in probe]
    place = {w: i for i, w in enumerate(words)}
    walker = Walker(parts)
    assert walker.ordinals(flat, starts, ends, 3).tolist() == [place.get(w, -1) for w in probe]
    few = {w: i for i, w in enumerate(words[:50])}
    assert walker.ordinals(flat, starts, ends, 5).tolist() == [few.get(w, -1) for w in probe]
    assert (walker.ordinals(flat, starts, ends, 4) == -1).all()


def test_term_ranges_do_not_cross_documents():
    import pyarrow as pa

    texts = ["abC", "dé", "", None, "1x"]
    block = next(blocks(pa.array(texts)))
    low, starts, ends, owner = divergence.term_ranges(block)
    found = [(low[a:z].tobytes().decode(), int(o)) for a, z, o in zip(starts, ends, owner)]
    assert found == [("abc", 0), ("dé", 1), ("x", 4)]
