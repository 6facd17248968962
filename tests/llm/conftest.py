from __future__ import annotations

import random

import pytest


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, shared lines and passages, nulls, empty ones and a long one."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdeéßñz") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    lines = [words(rng, 12, pool) for _ in range(6)]
    originals = [words(rng, rng.randint(20, 120), pool) for _ in range(25)]
    out = []
    for i in range(160):
        kind = i % 8
        text = rng.choice(originals) if kind < 3 else words(rng, rng.randint(0, 60), pool)
        if kind == 1:
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = "edit"
            text = " ".join(parts)
        if kind in (4, 5, 6):
            text = "\n".join([text, "  " + rng.choice(lines).upper() + "\t", rng.choice(lines)])
        out.append((i, text))
    out += [(500, None), (501, ""), (502, " \n\t\n"), (503, words(rng, 6000, pool)), (504, "one two"), (505, "ONE  two")]
    out += [(506, "a" * 400), (507, "a" * 60), (508, lines[0]), (508, lines[0])]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from feedloom.llm.storage import ready

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, line int"
    full = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), 0.5, 7) for i, t in rows]
    return ready(spark).createDataFrame(full, schema).repartition(5)


@pytest.fixture()
def empty(spark, docs):
    return docs.limit(0)
