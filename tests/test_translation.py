"""Leaves, rebuilding and translation of nested documents."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions import json_walk
from feedloom.operators import translate as tr
from feedloom.plans.translation import translate_documents, translate_stance
from feedloom.sources.topics import PROTECTED_KEYS, labels_ar


def nested(rng, depth):
    """A document with dots and digits in keys, empty containers and every scalar."""
    if depth == 0:
        return rng.choice(["Some text", "x", "", "12:30", "https://x.example/a", "2026-01-02 on", 7, -0.5, 1e300, True, None, "مرحبا", "é 😀"])
    if rng.random() < 0.4:
        return [nested(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    keys = ["a.b", "10", "9", "url", "title", "", "source", 'q"uote', "ключ"]
    return {k: nested(rng, depth - 1) for k in rng.sample(keys, rng.randint(0, 4))}


def changed(value, make, n):
    """``value`` with every translatable string replaced by ``make(number, text)``."""
    if isinstance(value, str):
        if not json_walk.translatable(value):
            return value
        n.append(0)
        return make(len(n) - 1, value)
    if isinstance(value, list):
        return [changed(v, make, n) for v in value]
    if isinstance(value, dict):
        order = sorted((k for k in value if k.isdigit()), key=int) + [k for k in value if not k.isdigit()]
        return {k: value[k] if k in PROTECTED_KEYS else changed(value[k], make, n) for k in order}
    return value


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(6)
    return [nested(rng, 9) for _ in range(40)] + [{"k": {"k": [[], {}, [{"x.url": "Keep me"}]]}}, [], {}, "Only text", 5, None]


def test_leaves_are_numbered_in_document_order(spark, trees):
    docs = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "doc INT, j STRING")
    got = {}
    for r in tr.json_leaves(docs, "doc", "j").orderBy("doc", "leaf").collect():
        got.setdefault(r.doc, []).append(r.value)
        value = trees[r.doc]
        for step in r.steps:
            value = value[int(step)] if isinstance(value, list) else value[step]
        assert value == r.value and r.path == ".".join(r.steps)
        assert not set(r.steps) & set(PROTECTED_KEYS)
    for i, tree in enumerate(trees):
        texts = []
        changed(tree, lambda n, t, texts=texts: texts.append(t) or t, [])
        assert got.get(i, []) == texts


def test_leaves_changed_and_rebuilt(spark, trees):
    docs = spark.createDataFrame([(f"d{i}", json.dumps(t)) for i, t in enumerate(trees)] + [("bad", "{"), ("none", None)], "doc STRING, j STRING")
    leaves = tr.json_leaves(docs, "doc", "j").cache()
    same = tr.rebuild_documents(docs, "doc", "j", leaves.select("doc", "leaf", F.col("value").alias("result")))
    new = leaves.filter("leaf % 2 = 0").select("doc", "leaf", F.concat(F.lit("<"), "leaf", F.lit('"> '), "value").alias("result"))
    other = {r.doc: r.rebuilt for r in tr.rebuild_documents(docs, "doc", "j", new).collect()}
    for r in same.collect():
        if r.doc in ("bad", "none"):
            assert r.rebuilt is None and other[r.doc] is None
            continue
        tree = trees[int(r.doc[1:])]
        assert json.loads(r.rebuilt) == tree
        assert json.loads(other[r.doc]) == changed(tree, lambda n, t: t if n % 2 else f'<{n}"> {t}', [])


def test_walk_is_strict_and_deep():
    deep = '{"k":[' * 3000 + '"End"' + "]}" * 3000
    valid, value = json_walk.parse(deep)
    assert valid and [p for p, _, _ in json_walk.strings(value, frozenset())] == [("k", 0) * 3000]
    for text in (None, "", "{", "{} x", "NaN", "[1,]", "{'a':1}", '["\x01"]', "[" * 100_000):
        assert json_walk.parse(text) == (False, None)
    assert json_walk.dump(json_walk.parse('{"b":1.0,"2":"x","a":2,"1":1e400,"b":3}')[1]) == '{"1":null,"2":"x","b":3,"a":2}'
    assert json_walk.dump(json_walk.parse('["\\ud800 a"]')[1]) == '["\\ud800 a"]'


def test_half_a_surrogate_pair(spark):
    docs = spark.createDataFrame([(1, '{"\\ud800":"Half \\udc00 pair"}')], "doc INT, j STRING")
    assert [(r.path, r.value) for r in tr.json_leaves(docs, "doc", "j").collect()] == [("?", "Half ? pair")]


def translator(rule):
    """Responses by ``rule(round, chunk, attempt, mapping)``, which gives status and content."""

    def run(requests):
        def rows(batches):
            for pdf in batches:
                out = [
                    (d, r, c, a, *rule(r, c, a, json.loads(m)))
                    for d, r, c, m in zip(pdf.doc, pdf["round"], pdf.chunk, pdf.mapping)
                    for a in (0, 1)
                ]
                yield type(pdf)(out, columns=["doc", "round", "chunk", "attempt", "status", "content"])

        return requests.mapInPandas(rows, "doc STRING, round INT, chunk LONG, attempt INT, status INT, content STRING")

    return run


def shout(mapping):
    return json.dumps({k: v.upper() + " ٤" for k, v in mapping.items()})


def translate(spark, payloads, rule, **kw):
    docs = spark.createDataFrame(list(payloads.items()), "doc STRING, j STRING")
    return {r.doc: (r.status, r.payload) for r in translate_documents(docs, "doc", "j", translator(rule), **kw).collect()}


def lines(n):
    return json.dumps({"list": [f"line {i}x" for i in range(n)], "url": "stay"}, separators=(",", ":"))


def test_failed_chunk_is_sent_again_in_fours(spark):
    """The second of three chunks fails twice; its leaves come back in the second round."""

    def rule(number, chunk, attempt, mapping):
        assert len(mapping) <= (6 if number == 1 else 4)
        if number == 1 and chunk == 1:
            return (500, None) if attempt == 0 else (200, "I cannot do that.")
        if number == 2 and chunk == 1:
            return 429, None  # in the second round this loses the chunk only
        return 200, "Sure: " + shout(mapping)

    got = translate(spark, {"a": lines(15)}, rule)["a"]
    want = [f"LINE {i}X 4" for i in range(6)] + [f"LINE {i}X 4" for i in range(6, 10)] + ["line 10x", "line 11x"] + [f"LINE {i}X 4" for i in range(12, 15)]
    assert got[0] == "translated" and json.loads(got[1]) == {"list": want, "url": "stay"}


def test_attempts_and_values_that_do_not_count(spark):
    def rule(number, chunk, attempt, mapping):
        if number == 1 and attempt == 0:
            return 200, '"just a text"'  # no object: the next attempt counts
        words = {k: v.upper() for k, v in mapping.items()}
        words.update({"v0": 5, "v1": "  ", "v9": "strange"} if number == 1 else {"v1": ""})
        return 200, json.dumps(words)

    got = translate(spark, {"a": lines(3)}, rule)["a"]
    assert json.loads(got[1])["list"] == ["LINE 0X", "line 1x", "LINE 2X"]


def test_documents_that_stay_as_they_are(spark):
    def rule(number, chunk, attempt, mapping):
        return (402, None) if "gone 7" in mapping.values() else (200, shout(mapping))

    payloads = {
        "large": lines(400), "bad": lines(2)[:-1], "bare": '{ "n": 1, "url": "Not me" }', "empty": None,
        "poor": json.dumps({"list": [f"gone {i}" for i in range(9)]}), "fine": '"Hello"',
    }
    got = translate(spark, payloads, rule, limit=2000)
    assert got.pop("fine") == ("translated", '"HELLO 4"')
    assert {k: v[1] for k, v in got.items()} == {k: v for k, v in payloads.items() if k != "fine"}
    assert {k: v[0] for k, v in got.items()} == {"large": "too_large", "bad": "invalid", "bare": "nothing", "empty": "invalid", "poor": "gave_up"}


def test_unusable_result_falls_back(spark, monkeypatch):
    """A rebuilt payload whose list came back shorter is not used."""
    from feedloom.plans import translation

    real = translation.rebuild_documents
    cut = lambda *a: real(*a).withColumn("rebuilt", F.replace("rebuilt", F.lit(',"LINE 1X 4"'), F.lit("")))
    monkeypatch.setattr(translation, "rebuild_documents", cut)
    got = translate(spark, {"short": lines(2), "whole": lines(1)}, lambda n, c, a, m: (200, shout(m)))
    assert got["short"] == ("translated", lines(2))
    assert json.loads(got["whole"][1])["list"] == ["LINE 0X 4"]


def test_stance_report(spark):
    rows = [("t1", "Iran", "Neutral / International", "Some summary", " ", "a story", None, 5), ("t2", "Unknown", "China", None, None, None, None, 6)]
    reports = spark.createDataFrame(
        rows, "doc STRING, left_label STRING, center_label STRING, summary STRING, top_left_story STRING, top_center_story STRING, top_right_story STRING, n INT"
    )
    got = {r.doc: r for r in translate_stance(reports, "doc", labels_ar(spark), translator(lambda n, c, a, m: (200, shout(m)))).collect()}
    known = {r.label_en: r.label_ar for r in labels_ar(spark).collect()}
    assert tuple(got["t1"]) == ("t1", known["Iran"], known["Neutral / International"], "SOME SUMMARY 4", " ", "A STORY 4", None, 5)
    assert tuple(got["t2"]) == ("t2", "Unknown", known["China"], None, None, None, None, 6)
