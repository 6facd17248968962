"""Each operator against a brute-force version, with nulls, repeated rows, empty tables and odd columns."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import (
    license_scan, line_dedup, lsh_ann, minhash, mixing, packing, quality_mil, suffix_dedup, weak_rules,
)
from feedloom.llm.suffix_array import common_prefixes, suffix_array
from feedloom.llm.text_arrays import blocks

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_line_dedup(docs, rows, empty):
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[low(line).strip(SPACE)].add(d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != d for k in (low(x).strip(SPACE) for x in lines)]
        want.append((d, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g).encode())))
    assert sum(w[2] for w in want) > 20
    assert sorted(map(tuple, line_dedup.line_digests(docs).collect())) == sorted(want)
    left = line_dedup.drop_lines(docs, line_dedup.line_bitmaps(docs))
    assert left.columns == docs.columns
    assert sorted((r.doc_id, sha((r.text or "").encode())) for r in left.collect()) == sorted((w[0], w[3]) for w in want)
    assert line_dedup.line_digests(empty).count() == 0


def test_line_dedup_null_ids(spark):
    line = "a line that is certainly longer than forty characters"
    some = spark.createDataFrame([(None, line), (None, line), (1, line), (2, line), (3, line), (4, line.upper())], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_digests(some).collect()}
    assert got == {None: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def components(rows):
    sets = defaultdict(list)
    for d, t in rows:
        w = WORD.findall(low(t))
        sets[d].append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            for x in sets[a] if a < b else ():
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= 75 * len(x | y):
                        u, v = sorted((find(a), find(b)))
                        parent[v] = u
    return {d: find(d) for d in sets}, {d: len(s[0]) for d, s in sets.items()}


def test_minhash(docs, rows, empty):
    want, sizes = components(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and sum(d != c for d, c in want.items()) > 20
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert sorted(set(r.doc_id for r in minhash.keep_one(docs).collect())) == sorted(set(want.values()))
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    some = spark.createDataFrame([(None, text), (3, text), (3, "other words stand here alone now"), (5, text), (6, "other words stand here alone now")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(some).collect())
    assert got == [(0, 0, True), (3, 3, True), (3, 3, True), (5, 3, False), (6, 3, False)]


def test_crowded_bucket_finds_links_that_the_star_misses():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    pool = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2))
    sets = [pool[:200], pool[180:380], pool[185:380]]
    keys, _ = minhash.signatures(sets)
    keys[:, 0] = 9
    keys[0, 1:] = 1
    table = pa.table(
        {
            "bucket": [9] * 3, "node": [1, 2, 3], "component": [1, 2, 3], "visits": [False, False, True],
            "bands": [k.view(np.int64).tolist() for k in keys],
            "shingles": pa.array([s.view(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
        }
    )
    assert minhash._links_in_block(table).to_pylist() == [{"u": 2, "v": 3}]


@pytest.mark.parametrize("size", [3, 60, 3000, 20_000])
def test_bitmaps_never_bound_too_low(size):
    rng = np.random.default_rng(size)
    pool = np.unique(rng.integers(0, 1 << 63, 2 * size).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, size + 1), replace=False)) for _ in range(12)]
    ends = np.cumsum([0, *map(len, sets)])
    maps, hidden = minhash.bitmaps(np.concatenate(sets), ends)
    for i in range(12):
        for j in range(12):
            shared = int(np.bitwise_count(maps[i] & maps[j]).sum()) + min(hidden[i], hidden[j])
            assert shared >= len(np.intersect1d(sets[i], sets[j]))


def test_bucket_of_many_members_and_one_stray(spark, docs):
    """Members of the largest component are shipped once, whatever else is in the bucket."""
    n = 20_000
    members = spark.range(n + 1).withColumnRenamed("id", "node")
    banded = members.select("node", F.lit(7).cast("long").alias("bucket"))
    bands = F.array(F.lit(7).cast("long"), *[(F.col("node") * 40 + i).cast("long") for i in range(1, minhash.BANDS)])
    shingles = F.when(F.col("node") < n, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).otherwise(F.array(F.lit(5).cast("long")))
    own, sets = members.select("node", bands.alias("bands")), members.select("node", shingles.alias("shingles"))
    stars = members.select(F.lit(0).cast("long").alias("u"), F.col("node").alias("v"), F.lit(1).alias("n"))
    found = members.where(F.col("node") < n).select("node", F.lit(0).cast("long").alias("component"))
    sent = spark.sparkContext.accumulator(0)
    real = minhash._links_in_block
    seen = lambda t: (sent.add(t.num_rows), real(t))[1]
    minhash._links_in_block = lambda group: seen(group)
    minhash._links_in_block.__annotations__ = real.__annotations__
    try:
        assert minhash._late_links(banded, own, sets, stars, found).count() == 0
    finally:
        minhash._links_in_block = real
    assert n < sent.value < n + 100


def test_minhash_repeated_ids_and_rows(spark, docs):
    """Rows that share an id are one document, linked through any of its texts, in any order."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefghij"), 40)) for _ in range(6)]
    rows = [(int(rng.integers(1, 12)), texts[int(rng.integers(6))]) for _ in range(40)] + [(50, texts[0] + " more"), (51, None), (None, texts[0])]
    some = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, _ = components([r for r in rows if r[0] is not None])
    for r in minhash.near_duplicates(some).collect():
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)


def test_densify_fills_every_bin():
    sets = [np.array([5], np.uint64), np.sort(np.random.default_rng(1).integers(0, 1 << 62, 30).astype(np.uint64))]
    keys, bins = minhash.signatures(sets)
    assert len(set(bins[0])) == 1 and keys.shape == (2, minhash.BANDS)


def suffix_want(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        yield d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))


@pytest.mark.parametrize("parts", [2, 24])
def test_suffix_dedup(spark, docs, rows, empty, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        want = sorted(suffix_want(rows))
        assert sum(w[2] for w in want) > 5000
        assert sorted(map(tuple, suffix_dedup.span_digests(docs).collect())) == want
        assert suffix_dedup.span_digests(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [2, 24])
def test_very_common_anchors_cross_shards(spark, docs, parts, monkeypatch):
    """Twelve thousand near copies: their anchors are cut at borders of shards and partitions."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1 << 13)
    rng = np.random.default_rng(9)
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    passage = rng.choice(letters, 90).tobytes()
    rows = []
    for i in range(12_000):
        own = rng.choice(letters, (2, 40))
        text = own[0].tobytes() + passage + own[1].tobytes()
        if i % 7 == 0:
            text = bytearray(text)
            text[40 + i % 90] = ord("!")
        rows.append((int(i * 7919 % 30_011), bytes(text).decode()))
    rows += [(40_000 + i, rows[i % 50][1]) for i in range(3000)] + [(50_000, "z" * 49), (50_001, "z" * 49), (50_002, "y" * 60), (50_003, "y" * 61)]
    least = {}
    for d, t in rows:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            least[w] = min(d, least.get(w, d))
    want = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < d:
                gone[k : k + 50] = True
        raw = np.frombuffer(t.encode(), np.uint8)
        want.append((d, len(t), int(gone.sum()), int(np.count_nonzero(np.diff(gone, prepend=False) & gone)), sha(raw[~gone].tobytes())))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, suffix_dedup.span_digests(df).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_prefixes_of_some_suffixes():
    """Only suffixes that are asked for are compared, each with the one before it among them."""
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    text[300:420] = text[100:220]
    raw, order = text.tobytes(), suffix_array(text)
    some = order[rng.random(len(order)) < 0.4]
    for limit in (1, 8, 50):
        plain = [0] + [len(os.path.commonprefix([raw[a : a + limit], raw[b : b + limit]])) for a, b in zip(some, some[1:])]
        assert common_prefixes(text, some, limit).tolist() == plain


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (0, 30, 49, 50, 51, 400, 0, 3000, 60, 1)]
    block = next(blocks(pa.array(texts)))
    found = []
    for piece in (1, 100, 1 << 16):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        at, hashes = suffix_dedup.anchors(block)
        found.append((at.tolist(), hashes.tolist()))
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 100


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(20):
        text = rng.integers(0, 3, int(rng.integers(1, 300))).astype(np.uint8)
        raw, order = text.tobytes(), suffix_array(text)
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
        shared = common_prefixes(text, order, 50)
        for i in range(1, len(order)):
            assert shared[i] == min(50, len(os.path.commonprefix([raw[order[i - 1] :], raw[order[i] :]])))


def test_weak_rules(docs, rows, empty):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in weak_rules.quality_rules(docs).collect()}
    want = set()
    for d, t in rows:
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        want.add((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), failed))
    assert got == want
    assert weak_rules.quality_rules(empty).count() == 0


def test_votes_recover_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.8
    votes = np.stack([np.where(rng.random(20000) < 0.3, 0, np.where(rng.random(20000) < a, 1, -1) * np.where(good, 1, -1)) for a in (0.9, 0.85, 0.8, 0.75)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_rules.fit_votes(patterns.astype(float), counts.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    assert abs(np.exp(model.good[0][2]) / 0.7 - 0.9) < 0.03 and abs(np.exp(model.bad[0][0]) / 0.7 - 0.9) < 0.05


def test_quality_learns_and_scores_every_row(spark, docs, rows, empty):
    base = "/root/testdata/sf0.01"
    texts, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality_mil.train(texts, labels)
    rest = labels.where(quality_mil.held_out(F.col("doc_id")))
    judged = quality_mil.score_documents(texts, model).join(rest, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in judged]) > 0.95
    found = quality_mil.score_documents(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert quality_mil.score_documents(empty, model).count() == 0
    assert {r.score for r in quality_mil.score_documents(docs, None).collect()} == {0.5}
    assert quality_mil.train(docs, labels.limit(0)) is None


def test_quality_of_a_text_does_not_depend_on_its_neighbours():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = ["", "a", "ab", "abc", "short text", "é", "The quick brown fox. " * 90] + ["".join(map(chr, rng.integers(32, 127, n))) for n in (3, 17, 59, 640, 641, 5000)]
    encode = lambda some: next(blocks(pa.array(some)))
    x, owner = quality_mil.passages(encode(texts))
    model = quality_mil.fit_bags(x.astype(float), owner, np.arange(len(texts)) % 2 * 1.0, epochs=2)
    for text in texts:
        alone, (score,), (top,) = quality_mil.passages(encode([text]))[0], *quality_mil._score_block(model, encode([text]))[::2]
        for before in texts:
            block = encode([before, text, text, before])
            x, owner = quality_mil.passages(block)
            scores, _, tops = quality_mil._score_block(model, block)
            for i in (1, 2):
                assert (x[owner == i] == alone).all() and scores[i] == score and tops[i] == top


def test_quality_learns_from_every_passage(spark, monkeypatch):
    # The telling passages lie between 64 evenly spaced ones.
    dull, bright = ("dull words " * 60)[: quality_mil.PASSAGE], ("!!$ 77 #*# " * 60)[: quality_mil.PASSAGE]
    texts = [(i, "".join(bright if i % 2 and k % 3 == 1 else dull for k in range(190))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    seen, fit = [], quality_mil.fit_bags
    monkeypatch.setattr(quality_mil, "fit_bags", lambda x, owner, y: seen.append((np.bincount(owner), y, x)) or fit(x, owner, y))
    model = quality_mil.train(docs, labels)
    assert set(seen[0][0]) == {190} and len(seen[0][0]) > 30
    assert all((r.score >= 0.5) == r.doc_id % 2 for r in quality_mil.score_documents(docs, model).collect())
    quality_mil.train(docs, labels, sample_passages=190 * 7)
    assert seen[1][0].tolist() == [190] * 7
    assert quality_mil.within([5, 5, 5, 5], [1, 1, 1, 0], 7) == 4 and quality_mil.within([5, 5, 5], [1, 0, 1], 10) == 2


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    x, owner, y = rng.normal(size=(9, quality_mil.N_FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])
    model = quality_mil.fit_bags(x, owner, y, epochs=1)
    grads = model.step(x, owner, y, 0.0)

    def loss():
        p = model.forward(x, owner, 4)["out"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, at in (("E", (3, 4)), ("V", (2, 1)), ("U", (5, 3)), ("w", (2,)), ("c", (7,)), ("b", (0,))):
        kept = model.weights[name][at]
        model.weights[name][at] = kept + 1e-6
        up = loss()
        model.weights[name][at] = kept - 1e-6
        down = loss()
        model.weights[name][at] = kept
        assert abs((up - down) / 2e-6 - grads[name][at]) < 1e-5


def test_packing_round_trip(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    odd = [(700, "Don't\tΑΣ. x,́y ≠ é,É! ×a÷ A1b2_c <|startoftext|>B<|ENDOFTEXT|> İx ı 12.5€—,"), (701, None)]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    model = Tokenizer.from_file(packing.vocabulary_path())
    ids = [(d, model.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows + odd]
    want = Counter((d, zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for d, x in ids)
    whole = packing.pack(some, window=1 << 30).collect()
    assert Counter((r.doc_id, r.ids_crc32, r.doc_tokens) for r in whole) == want
    pieces = packing.pack(some, window=100).collect()
    spots = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    total = sum(n for _, _, n in want.elements())
    assert [s * 100 + o for s, o, _ in spots] == [sum(n for _, _, n in spots[:i]) for i in range(len(spots))]
    assert sum(n for _, _, n in spots) == total and all(o + n <= 100 for _, o, n in spots)
    made = packing.packed_sequences(some, window=100).collect()
    assert sorted(len(r.ids) // 4 for r in made) == sorted([100] * (total // 100) + [total % 100] * (total % 100 > 0))
    assert packing.pack(empty).count() == 0


def test_packing_memory_starts_anew():
    import pyarrow as pa

    texts = ["alpha beta gamma delta", "beta epsilon, zeta. eta theta", "alpha alpha iota 7 kappa"]
    small, large = packing.WordTokenizer(packing.vocabulary_path(), 4), packing.WordTokenizer(packing.vocabulary_path())
    for text in texts * 2:
        for block in blocks(pa.array([text])):
            assert small.encode(block)[0].tolist() == large.encode(block)[0].tolist()


def test_mixing(docs, rows, empty):
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    got = Counter((r.doc_id, r.copy) for r in mixed.collect())
    assert got and all(n == (2 if d == 508 else 1) for (d, _), n in got.items())
    assert got == Counter((r.doc_id, r.copy) for r in mixing.mix_sources(docs.repartition(2)).collect())
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_reaches_weights(spark):
    many = spark.range(20000).selectExpr("id as doc_id", "repeat('x', 100) as text", "case when id % 10 < 7 then 'a' when id % 10 < 9 then 'b' end as source")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 4.0)], "source string, weight double")
    counts = {r.source: r["count"] for r in mixing.mix_sources(many, weights, budget=2.0).groupBy("source").count().collect()}
    for source, share in (("a", 1 / 8), ("b", 3 / 8), (None, 1 / 2)):
        assert abs(counts[source] / 40000 - share) < 0.02
    large = mixing.mix_sources(many.where("doc_id < 1000"), budget=50.0)
    assert abs(large.count() / 50000 - 1) < 0.03


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[50:90] = x[3]
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (None, [1.0] * 16), (1050, [1.0, 2.0]), (5, x[5].tolist())]
    some = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in lsh_ann.nearest(some, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 700, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(700), -s))[:5]
        ranked = sorted(got[q])
        assert [r for r, _, _ in ranked] == [1, 2, 3, 4, 5] and all(abs(c - u[v] @ u[q]) < 1e-12 for _, v, c in ranked)
        hits += len({v for _, v, _ in ranked} & set(best.tolist()))
    assert hits >= 0.9 * 5 * 14
    assert [v for _, v, _ in sorted(got[50])] == [3, 51, 52, 53, 54]
    assert set(got) == set(range(0, 700, 50))
    assert lsh_ann.nearest(some.limit(0), F.lit(True)).count() == 0
    few = lsh_ann.nearest(some.where("vec_id < 3"), F.lit(True)).collect()
    assert len(few) == 6


def test_license_scan(spark, empty):
    text = "é intro\nReleased under the MIT License.\nmore Licensed  under the APACHE licence, Version 2.0 end. This work is licensed under the GNU General Public, version 3."
    some = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "released the license under mit"), (5, "Released under the MIT License. " * 300)], "doc_id long, text string")
    got = sorted(license_scan.scan_licenses(some).collect(), key=lambda r: (r.doc_id, r.start))
    assert [(r.doc_id, r.license) for r in got[:3]] == [(1, "MIT"), (1, "Apache-2.0"), (1, "GPL-3.0")]
    assert text[got[0].start : got[0].stop] == "Released under the MIT License" and got[0].coverage == 1
    assert got[1].coverage == 7 / 8 and len(got) == 303
    assert license_scan.scan_licenses(empty).count() == 0


def test_nearest_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(120, 16))
    x[:60] = x[119] * rng.permutation(np.arange(1, 61))[:, None]  # one direction, sixty lengths
    x[60:100] = np.eye(16)[np.arange(40) % 4] * np.arange(1, 41)[:, None]
    ids = rng.permutation(120)
    some = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in lsh_ann.nearest(some, F.lit(True)).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for at in range(100):
        s = np.round(u @ u[at], 10)
        s[at] = -9
        # All five have the query's own direction, which shares its buckets.
        assert [v for _, v in sorted(got[ids[at]])] == ids[np.lexsort((ids, -s))[:5]].tolist()


def test_no_likely_neighbour_is_left_out():
    """Scores that differ by the rounding of a matrix product at most are all compared exactly."""
    rng = np.random.default_rng(11)
    scores = rng.integers(-3, 4, (200, 50)) / 7 + rng.normal(size=(200, 50)) * 1e-16
    row, column = lsh_ann._likely(scores, 6)
    for i, some in enumerate(scores):
        assert set(np.flatnonzero(np.round(some, 12) >= np.sort(np.round(some, 12))[-6])) <= set(column[row == i])


def test_scores_are_cosines_of_the_original_vectors(spark, docs):
    """Not rounded to some decimals, equal for multiples of a vector, and safe from overflow."""
    from fractions import Fraction
    from math import isqrt

    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 8)) * 10.0 ** rng.integers(-150, 150, (60, 1))
    x[40:50] = x[0] * 2.0 ** rng.integers(-40, 40, (10, 1))
    x[50:55] = x[0] + x[0] * 1e-9 * rng.normal(size=(5, 8))
    some = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")

    def cosine(a, b):
        a, b = ([Fraction(float(v)) for v in y] for y in (a, b))
        dot, size = sum(p * q for p, q in zip(a, b)), sum(p * p for p in a) * sum(q * q for q in b)
        root = Fraction(isqrt(size.numerator * size.denominator << 400), size.denominator << 200)
        return float(dot / root)

    want = [(cosine(x[0], x[v]), v) for v in range(1, 60)]
    got = [(r.score, r.vec_id) for r in lsh_ann.nearest(some, F.col("vec_id") == 0, 15).orderBy("rank").collect()]
    assert got == sorted(want, key=lambda w: (-w[0], w[1]))[:15]


def scanned(texts, templates=license_scan.TEMPLATES, coverage=license_scan.COVERAGE):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    found = defaultdict(list)
    for out in license_scan.scan(templates, coverage)(iter([batch])):
        for r in sorted(out.to_pylist(), key=lambda r: (r["doc_id"], r["start"])):
            found[r["doc_id"]].append(r)
    return found


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_license_scan_finds_one_word_edits_everywhere(name):
    words = re.findall("[a-z0-9]+", license_scan.TEMPLATES[name].lower())
    n = len(words)
    around = lambda w: "Before it, of the " + " ".join(w) + " under no way."
    edits = [words[:i] + new + words[j:] for i in range(n) for new, j in ((["zz"], i + 1), ([], i + 1), (["zz"], i)) if (new, j) != (["zz"], 0) and not (j == i and i == 0)]
    found = scanned([around(words), *map(around, edits)])
    assert [(r["license"], r["coverage"]) for r in found[0]] == [(name, 1.0)]
    for k in range(1, len(edits) + 1):
        # Whatever is reported explains the words at least as well as the template itself.
        assert any(2 * r["n_matched"] - r["n_matched"] / r["coverage"] >= n - 2 - 1e-9 for r in found[k]), edits[k - 1]


def test_license_scan_tells_siblings_apart():
    texts = {
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        license_scan.TEMPLATES["BSD-2-Clause"]: "BSD-2-Clause",
    }
    found = scanned(list(texts))
    assert [[r["license"] for r in found[i]] for i in range(len(texts))] == [[x] for x in texts.values()]
    (row,) = scanned(["Licensed under CC zz BY 4.0"], {"CC-BY-4.0": "Licensed under CC BY 4.0"})[0]
    assert row["coverage"] == 6 / 7 and row["n_matched"] == 6


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row


def test_winnowing_windows_follow_template_and_coverage():
    """A window never outgrows the run of matched words that a notice is sure to hold."""
    for n in (1, 2, 7, 30, 60):
        for coverage in (0.6, 0.8, 0.9, 0.97, 1.0):
            run = license_scan.least_run(n, coverage)
            for lacking in range(n + 1):
                for added in range(n + 1):
                    m = n - lacking
                    if m and m >= coverage * max(n, m + added) - 1e-9:
                        assert run <= -(-m // (lacking + added + 1))
    windows = {key[1] for key in license_scan.Index(license_scan.TEMPLATES, 0.97).known}
    assert max(windows) > 5 and {k[1] for k in license_scan.Index(license_scan.TEMPLATES, 0.8).known} == {1, 2}
    rng = np.random.default_rng(2)
    for _ in range(50):  # a shared run of eleven values, anywhere, shares a chosen one
        run = rng.integers(0, 9, 11)
        a, b = (np.concatenate([rng.integers(0, 9, k), run, rng.integers(0, 9, 5)]) for k in rng.integers(0, 9, 2))
        chosen = [set(x[license_scan.winnow(np.arange(len(x)), x, np.zeros(len(x), int), 11)].tolist()) for x in (a, b)]
        assert chosen[0] & chosen[1]


@pytest.mark.parametrize("coverage", [0.8, 0.6, 1.0, 0.9, 0.93])
def test_license_scan_matches_plain_alignment_at_every_place(coverage):
    rng = np.random.default_rng(9)
    templates = {"one": "z", "two": "y z", "five": "a b c d a", "six": "a b e c d a", "nine": "b a a c e d b f c", "twelve": "a b c d e f a b g h i j",
                 "long": "a b c d e f g h i j k l m n a c e g i k m b d f h j l n"}
    texts = [""]
    for _ in range(150):
        words = []
        for _ in range(int(rng.integers(1, 4))):
            words += rng.choice(list("abcdefghijklmn"), int(rng.integers(0, 6))).tolist()
            for w in templates[str(rng.choice(list(templates)))].split():
                words += [[w], [w], [w], [w], [w], [w], [], ["q"], [w, "q"]][rng.integers(9)]
        texts.append(" ".join(words))
    found = scanned(texts, templates, coverage)
    n_rows = 0
    for k, text in enumerate(texts):
        words, every = text.split(), []
        for name, template in templates.items():
            template = template.split()
            for i in range(len(words)):
                row = common_words(template, words[i:])
                for span in range(1, len(words) - i + 1):
                    m, whole = row[span], max(len(template), span)
                    if m > row[span - 1] and m >= coverage * whole - 1e-9:
                        every.append((whole - 2 * m, -m / whole, span, i, name, m))
        taken, want = set(), []
        for _, less, span, i, name, m in sorted(every):
            if not taken & set(range(i, i + span)):
                taken |= set(range(i, i + span))
                a = len(" ".join(words[:i])) + (i > 0)
                want.append((a, a + len(" ".join(words[i : i + span])), name, m, -less))
        assert [(r["start"], r["stop"], r["license"], r["n_matched"], r["coverage"]) for r in found[k]] == sorted(want)
        n_rows += len(want)
    assert n_rows > 50


def test_stages_with_clashing_columns(spark, docs, rows):
    """Columns named like those that a stage works with come out as they went in."""
    names = ["keep", "n_dropped", "text_key", "doc", "copy", "h1", "node", "score", "component_id", "kept", "set_key", "fingerprint", "rate", "terms"]
    wide = docs.select("doc_id", "text", "source", "n_chars", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    left = line_dedup.drop_lines(wide, line_dedup.line_bitmaps(wide))
    plain = line_dedup.drop_lines(docs, line_dedup.line_bitmaps(docs))
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted((r.doc_id, r.text or "") for r in plain.collect())
    stages = {
        "lines": left,
        "one": minhash.keep_one(wide),
        "mix": mixing.mix_sources(wide, number="__number").select(*wide.columns),
        "good": quality_mil.keep_good(wide, None),
    }
    for name, df in stages.items():
        assert df.columns == wide.columns, name
        found = df.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names), name


def test_passages_of_a_long_text_in_slices(monkeypatch):
    """Slices of any size give the same vectors, so a long text needs no more memory at a time."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abé .\n"), n)) for n in (0, 1, 639, 640, 641, 9000, 0, 20_000)] + [None]
    whole = [quality_mil.passages(b) for b in blocks(pa.array(texts))]
    monkeypatch.setattr(quality_mil, "SLICE", 3)
    for (x, owner), block in zip(whole, blocks(pa.array(texts))):
        y, again = quality_mil.passages(block)
        assert (x == y).all() and (owner == again).all()


def test_hashes_of_ranges_do_not_depend_on_their_place():
    import pyarrow as pa

    text = "abc" + "x" * 1_100_000 + "abc" + "y" * 3_000_000 + "abc"
    block = next(blocks(pa.array([text])))
    starts = np.array([0, 1_100_003, len(text) - 3])
    for which in (0, 1):
        assert len(set(block.hasher(None, which)(starts, starts + 3).tolist())) == 1
