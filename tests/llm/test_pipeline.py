"""Every stage of the pipeline against a plain Python version, each on its predecessor's rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from feedloom.llm import packing, quality_mil
from feedloom.llm.storage import ready, stored
from tests.llm.test_operators import components, low

SPACE = " \t\n\x0b\x0c\r"


def plain_vector(raw: bytes, begin: int, end: int) -> list[float]:
    """One passage of a document, byte by byte."""
    part, n = raw[begin:end], max(1, end - begin)
    groups = [0] * quality_mil.N_GROUPS
    for b in part:
        groups[quality_mil.GROUPS[b]] += 1
    cells = [0] * quality_mil.CELLS
    for i in range(max(begin, 2), end):
        code = raw[i - 2] << 16 | raw[i - 1] << 8 | raw[i]
        cells[(code * 0x9E3779B1 >> 13) % quality_mil.CELLS] += 1
    words = [m.end() - m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw) if begin <= m.start() < end]
    mean = sum(words) / max(1, len(words))
    spread = max(0, sum(w * w for w in words) / max(1, len(words)) - mean**2)
    folded = [sum(cells[k :: quality_mil.FOLDED]) for k in range(quality_mil.FOLDED)]
    return [
        *(math.sqrt(g / n) for g in groups), sum(c > 0 for c in cells) / n, math.sqrt(max(cells) / n), math.sqrt(sum(c * c for c in cells)) / n,
        mean / 8, math.sqrt(spread) / 8, *(math.sqrt(f / n) for f in folded),
    ]


def plain_score(model, text) -> float:
    """The attention model on one text: encode passages, weigh them, score the weighted passage."""
    raw, p = (text or "").encode(), model.weights
    n = max(1, -(-len(raw) // quality_mil.PASSAGE))
    cuts = [-(-k * len(raw) // n) for k in range(n + 1)]
    hidden, logits = [], []
    for a, z in zip(cuts, cuts[1:]):
        x = (np.array(plain_vector(raw, a, z)) - model.mean) / model.scale
        h = np.maximum(x @ p["E"] + p["e"], 0)
        logits.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        hidden.append(h)
    weights = np.exp(np.array(logits) - max(logits))
    bag = (weights / weights.sum()) @ np.array(hidden)
    return float(1 / (1 + math.exp(-(bag @ p["c"] + p["b"][0]))))


def plain_lines(rows):
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[low(line).strip(SPACE)].add(d)

    def left(d, t):
        keys = [(x, low(x).strip(SPACE)) for x in t.split("\n")]
        return "\n".join(x for x, k in keys if len(k) < 40 or len(holders[k]) < 5 or max(holders[k]) == d)

    return [(d, t if t is None else left(d, t), *rest) for d, t, *rest in rows]


def plain_copies(rows):
    """How often each document stands in the mix."""
    chars = Counter()
    for d, t, source in rows:
        chars[source] += len(t or "")
    weight = {s: math.sqrt(n) for s, n in chars.items() if n}
    out = Counter()
    for d, t, source in rows:
        if not chars[source]:
            continue
        rate = sum(chars.values()) * weight[source] / sum(weight.values()) / chars[source]
        terms = math.ceil(rate / 16)
        mean, steps = rate / terms, []
        p = c = math.exp(-rate / terms)
        for k in range(81):
            steps.append(c)
            p *= mean / (k + 1)
            c += p
        for i in range(1, terms + 1):
            u = int(hashlib.md5(f"7:{i}:{d}".encode()).hexdigest()[:13], 16) / 16**13
            out[d] += sum(c <= u for c in steps)
    return +out


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    labels = [(i, int("edit" not in (t or "") and i % 8 > 2)) for i, t in [(r.doc_id, r.text) for r in docs.collect()] if i < 160]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    docs.dropDuplicates(["doc_id"]).write.parquet(f"{base}/documents.parquet")
    return base


def test_stages_against_plain_versions(spark, folder):
    ready(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, before = docs.columns, [tuple(r) for r in docs.collect()]
    at = {n: i for i, n in enumerate(names)}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), "stage")
        rows = [tuple(r) for r in out.collect()]
        if name != "packing":
            assert out.columns == names
        seen[name] = (before, rows)
        docs, before = out, rows

    given, kept = seen["quality classifier"]
    model = quality_mil.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r[0]: plain_score(model, r[1]) for r in given}
    found = {r.doc_id: r.score for r in quality_mil.score_documents(spark.read.parquet(f"{folder}/documents.parquet"), model).collect()}
    assert all(abs(found[d] - s) < 1e-4 for d, s in scores.items())
    assert {r[0] for r in kept} == {d for d, s in found.items() if s >= 0.5} and 20 < len(kept) < len(given)
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in given if found[r[0]] >= 0.5)

    given, left = seen["line dedup"]
    want = [(*r[: at["n_chars"]], len(r[1] or ""), *r[at["n_chars"] + 1 :]) for r in plain_lines(given)]
    same = lambda rows: sorted((r[0], r[1] or "", repr(r[2 : at["n_chars"]])) for r in rows)
    assert same(left) == same(want) and left != given
    assert all(r[at["n_chars"]] == (None if r[1] is None else len(r[1])) for r in left)

    given, one = seen["near-duplicates"]
    component, _ = components([(r[0], r[1]) for r in given])
    assert sorted(map(repr, one)) == sorted(repr(r) for r in given if component[r[0]] == r[0]) and len(one) < len(given)

    given, mixed = seen["mixing"]
    assert Counter(r[0] for r in mixed) == plain_copies([(r[0], r[1], r[at["source"]]) for r in given])
    whole = {r[0]: r for r in given}
    assert all(r == whole[r[0]] for r in mixed)

    given, pieces = seen["packing"]
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.vocabulary_path()).encode
    ids = {r[0]: [*encode(r[1] or "", add_special_tokens=False).ids, 1] for r in given}
    spots = sorted((p[5], p[6], p[2]) for p in pieces)
    assert [s for s, o, _ in spots if o == 0] == list(range(spots[-1][0] + 1))
    assert all(o + n == (o2 if s == s2 else 2048) for (s, o, n), (s2, o2, _) in zip(spots, spots[1:]))
    covered = defaultdict(Counter)
    for doc, start, length, crc, total, _, _ in pieces:
        assert crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes()) and total == len(ids[doc])
        covered[doc].update(range(start, start + length))
    copies = Counter(r[0] for r in given)
    assert all(covered[d] == Counter({k: copies[d] for k in range(len(ids[d]))}) for d in copies)


def test_run_applies_all_stages(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert pieces and set(pieces[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
