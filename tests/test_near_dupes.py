"""Greedy headline de-duplication against the plain one-by-one loop."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from feedloom.functions.text import title_words
from feedloom.operators import near_dupes
from feedloom.operators.near_dupes import TitleGroups, dedupe_titles, title_pairs

SCHEMA = "conflict STRING, pos BIGINT, ts_raw STRING, title STRING"


def words(title):
    return {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", (title or "").lower())) if len(w) > 3}


def one_by_one(rows, min_shared=4):
    kept, absorbed = {}, {}
    for conflict, pos, _, title in sorted(rows, key=lambda r: (r[0], r[2] or "", r[1])):
        mine = words(title)
        hit = next((k for k in kept.get(conflict, []) if len(k[1] & mine) >= min_shared), None)
        if hit is None:
            kept.setdefault(conflict, []).append((pos, mine))
        else:
            absorbed[conflict, pos] = (hit[0], len(hit[1] & mine))
    return {(c, p) for c, items in kept.items() for p, _ in items}, absorbed


def check(spark, rows, **options):
    groups = TitleGroups(spark.createDataFrame(rows, SCHEMA), **options)
    kept, absorbed = one_by_one(rows)
    assert {tuple(r) for r in groups.kept_positions().collect()} == kept
    found = {(r.conflict, r.pos): (r.kept_pos, r.shared) for r in groups.absorbed().collect()}
    assert found == absorbed


def random_rows(seed, n, vocabulary, per_title, groups=2):
    rng = random.Random(seed)
    # Squared draw: a few words are in most titles.
    word = lambda: f"word{int(vocabulary * rng.random() ** 2):03d}"
    return [
        (f"t{rng.randrange(groups)}", i, f"2024-01-{rng.randrange(1, 6):02d}", " ".join(word() for _ in range(rng.randrange(2, per_title))))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed, n, vocabulary, per_title, posting", [
    (1, 120, 40, 9, 128),
    (2, 150, 25, 10, 4),
    (3, 200, 60, 12, 8),
    (4, 100, 12, 8, 2),
])
def test_matches_one_by_one(spark, seed, n, vocabulary, per_title, posting):
    rows = random_rows(seed, n, vocabulary, per_title)
    check(spark, rows, max_posting=posting)
    # All rounds as joins, none left to one task at the end.
    check(spark, rows, max_posting=posting, last_rows=0)


def test_not_transitive_and_ties(spark):
    rows = [
        ("t", 0, "2024-01-01", "alpha bravo charlie delta echoes"),
        ("t", 1, "2024-01-01", "bravo charlie delta echoes foxtrot golfing"),
        ("t", 2, "2024-01-02", "delta echoes foxtrot golfing hotel"),
        ("u", 3, "2024-01-02", "alpha bravo charlie delta echoes"),
        ("t", 4, None, "one two"),
        ("t", 5, "2024-01-03", None),
    ]
    check(spark, rows)
    kept, _ = one_by_one(rows)
    survivors = dedupe_titles(spark.createDataFrame(rows, SCHEMA))
    assert {(r.conflict, r.pos) for r in survivors.collect()} == kept and survivors.columns == ["conflict", "pos", "ts_raw", "title"]


def test_template_titles_stay_linear(spark):
    """A third of a topic shares one template: settled as a clique, not as pairs."""
    template = [("t", i, f"2024-01-01T{i:06d}", f"breaking news update from sector {i:05d}x") for i in range(3000)]
    others = [("t", 10_000 + i, "2024-01-02", f"story{i:05d} about thing{i:05d} near place{i:05d}") for i in range(3000)]
    groups = TitleGroups(spark.createDataFrame(template + others, SCHEMA), max_posting=32)
    assert groups.kept_positions().count() == 1 + len(others)
    # Linear: a few four-word keys per title instead of 4.5 million pairs.
    assert groups.members.count() <= 10 * len(template)


def test_copies_collapse(spark):
    rows = [("t", i, "2024-01-01", "same headline copied everywhere today") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.pos for r in dedupe_titles(df).collect()] == [0]
    pairs = title_pairs(df).collect()
    assert len(pairs) == 499 and {(r.kept_pos, r.shared) for r in pairs} == {(0, 5)}


def test_long_chain_of_repeats_takes_rounds(spark):
    """Each title repeats the one before it: every second one stays, whatever is left to the last task."""
    rows = [("t", i, "2024-01-01", " ".join(f"word{i * 2 + k:04d}" for k in range(6))) for i in range(14)]
    for last in (0, 5, 500):
        check(spark, rows, last_rows=last)


def test_empty(spark):
    assert dedupe_titles(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_titles_of_common_words_stay_linear(spark):
    """Nobody's words are rare: one verdict a title, not a row for each four words it shares with others."""
    rng = random.Random(7)
    rows = [("t", i, "2024-01-01", " ".join(rng.sample([f"word{k:02d}" for k in range(40)], 14))) for i in range(200)]
    check(spark, rows, max_posting=16)
    assert TitleGroups(spark.createDataFrame(rows, SCHEMA), max_posting=16).members.count() == len(rows)


@pytest.mark.parametrize("step, cells", [(512, 1 << 21), (7, 50), (1, 1)])
def test_block_is_settled_in_order(monkeypatch, step, cells):
    """Whatever part of a block is compared at a time."""
    monkeypatch.setattr(near_dupes, "STEP", step)
    monkeypatch.setattr(near_dupes, "CELLS", cells)
    sets = sorted({(c, " ".join(sorted(words(title)))): i for c, i, _, title in random_rows(5, 120, 50, 12, groups=1) if len(words(title)) >= 4}.items(), key=lambda x: x[1])
    block = pa.table({"conflict": [c for (c, _), _ in sets], "oid": [i for _, i in sets], "words": [w for (_, w), _ in sets]})
    kept, absorbed = one_by_one([(c, i, "", w) for (c, w), i in sets])
    half = len(sets) // 2
    first = near_dupes._settle_block(block[:half].take(list(reversed(range(half)))), 4)
    heads = first.filter(pc.is_valid(first["words"])).select(["conflict", "oid", "words"])
    met = near_dupes._drop_repeats(block[half:], heads, 4)
    second = near_dupes._settle_block(met.filter(pc.is_valid(met["words"])).select(["conflict", "oid", "words"]), 4)
    rows = first.to_pylist() + met.filter(pc.is_null(met["words"])).to_pylist() + second.to_pylist()
    assert {("t0", r["oid"]) for r in rows if r["oid"] == r["kept_oid"]} == kept and len(rows) == len(sets)
    assert {("t0", r["oid"]): (r["kept_oid"], r["shared"]) for r in rows if r["oid"] != r["kept_oid"]} == absorbed


def test_words_are_cut_in_one_step(spark, capsys):
    """Replacing characters before the cut took most of the time of the feeds that drop repeats."""
    titles = [None, "", "  ", "Ünïted Nations' 2nd\tmeeting\n(of meeting_rooms)", "İzmir—Ankara 12345 𝒳abcd", "--", "four four FOUR five"]
    rows = spark.createDataFrame([(t,) for t in titles], "title STRING").select("title", title_words(F.col("title")).alias("words"))
    for title, found in rows.collect():
        plain = re.sub(r"[^a-z0-9\s]", " ", (title or "").lower(), flags=re.ASCII)
        assert found == list(dict.fromkeys(w for w in plain.split() if len(w) > 3))
    rows.explain(True)
    assert "regexp_replace" not in capsys.readouterr().out


def test_size_estimates_stay_with_the_rows(spark, monkeypatch, capsys):
    """Joins estimate the product of their sides: carried from round to round, the number's digits grew fivefold each time."""
    real, plans = near_dupes.small_side, []

    def explained(df, *rest):
        df.explain("cost")
        plans.append(capsys.readouterr().out)
        return real(df, *rest)

    monkeypatch.setattr(near_dupes, "small_side", explained)
    check(spark, [("t", i, "2024-01-01", " ".join(f"word{i * 5 + k:04d}" for k in range(6))) for i in range(70)], max_posting=4, last_rows=0)
    estimates = [re.findall(r"sizeInBytes=(\S+)", plan) for plan in plans]
    assert len(estimates) >= 8 and all(estimates)
    assert not [x for found in estimates for x in found if "E+" in x]
