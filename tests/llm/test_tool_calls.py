"""Linked tool calls against a plain version over random conversations."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest

from feedloom.llm import tool_calls
from feedloom.llm.tool_calls import SCHEMAS, link_calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string"
RESULTS = "conv_id long, turn long, call_id string, content string"
NEEDS = "conv_id long, call_id string, needs string"


def first_key(call):
    return tuple((x is not None, x if x is not None else "") for x in call)


def levels(ids, needs):
    """Longest paths; None for calls that reach a cycle."""
    below = defaultdict(set)
    for conv, call, need in needs:
        if (conv, call) in ids and (conv, need) in ids:
            below[conv, call].add((conv, need))
    out: dict = {}
    while True:
        more = {i: 1 + max((out[x] for x in below[i]), default=-1) for i in ids if i not in out and all(x in out for x in below[i])}
        if not more:
            return {i: out.get(i) for i in ids}
        out |= more


def plain(calls, results, needs):
    calls, results = set(calls), set(results)
    held = defaultdict(list)
    for conv, turn, call, *rest in calls:
        if conv is not None and call is not None:
            held[conv, call].append((turn, *rest))
    firsts = {i: min(c, key=first_key) for i, c in held.items()}
    level = levels(set(firsts), [*needs, *((conv, call, c[3]) for (conv, call), c in firsts.items())])
    rows = []
    for conv, turn, call, name, arguments, after in calls:
        mine = (conv, call) in firsts and firsts[conv, call] == (turn, name, arguments, after)
        if not mine:
            rows.append((conv, call, turn, None, "repeated" if (conv, call) in firsts else "unanswered", None, name, arguments, None, False))
            continue
        answers = [r for r in results if (r[0], r[2]) == (conv, call)]
        for r in answers or [None]:
            rows.append((conv, call, turn, level[conv, call], "linked" if r else "unanswered", r and r[1], name, arguments, r and r[3], bool(r)))
    rows += [(r[0], r[2], None, None, "orphan", r[1], None, None, r[3], True) for r in results if (r[0], r[2]) not in firsts]
    return rows


def seen(calls, results, needs):
    want = Counter()
    for conv, call, turn, level, status, result_turn, name, arguments, content, answered in plain(calls, results, needs):
        record = {"id": call}
        if status != "orphan":
            record["call"] = {"name": name, "arguments": json.loads(arguments)}
        if answered:
            record["result"] = content
        want[conv, call, turn, level, status, result_turn, json.dumps(record, sort_keys=True)] += 1
    return want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, docs, seed):
    """Ids are reused between conversations, repeated inside them, null, and needed in cycles."""
    rng = random.Random(seed)
    ids = [f"call_{i}" for i in range(9)]
    pick = lambda options, gone: None if rng.random() < gone else rng.choice(options)
    calls = [
        (pick(range(8), 0.05), pick(range(30), 0.05), pick(ids, 0.05), pick(["search", "classify", "nope"], 0.1), json.dumps({"query": rng.randint(0, 2)}), pick(ids, 0.7))
        for _ in range(90)
    ]
    results = [(pick(range(9), 0.05), pick(range(30), 0.05), pick(ids, 0.05), pick(["r", "s"], 0.2)) for _ in range(70)]
    needs = [(pick(range(8), 0.05), f"call_{(k := rng.randrange(9))}", f"call_{rng.randrange(k) if k and rng.random() < 0.95 else k}") for _ in range(60)] + [(None, None, "call_1"), (1, "call_2", None)]
    calls += calls[:5]
    results += results[:5]
    got = link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS, spark.createDataFrame(needs, NEEDS)).collect()
    found = Counter((r.conv_id, r.call_id, r.turn, r.level, r.status, r.result_turn, json.dumps(json.loads(r.record), sort_keys=True)) for r in got)
    want = seen(calls, results, needs)
    assert found == want
    assert {w[4] for w in want} == {"linked", "unanswered", "orphan", "repeated"} and max(w[3] or 0 for w in want) > 1


def test_arguments_and_records(spark, docs):
    deep = '{"query":' + "[" * 900 + "]" * 900 + "}"
    cases = [
        ('{"top_k": 3.0, "query": "é"}', "$.top_k: not of type integer", '{"query":"é","top_k":3}'),
        ('{"query": 1}', "$.query: not of type string", '{"query":1}'),
        ("{", "arguments are not JSON", '"{"'),
        (None, "$: not of type object", "null"),
        ('{"query":"\\ud800"}', None, '{"query":"\\ud800"}'),
        ('{"query":NaN}', "arguments are not JSON", '"{\\"query\\":NaN}"'),
        ('{"query":1e400}', "arguments are not JSON", '"{\\"query\\":1e400}"'),
        ('{"\\udfff":true,"query":"a"}', "$.\\udfff: not expected", '{"query":"a","\\udfff":true}'),
        (deep, None, None),
        ("[" * 50_000, "arguments are not JSON", None),
    ]
    calls = spark.createDataFrame([(1, i, f"c{i}", "search", a, None) for i, (a, _, _) in enumerate(cases)], CALLS)
    got = {r.turn: r for r in link_calls(calls, spark.createDataFrame([], RESULTS), SCHEMAS).collect()}
    for i, (_, issue, arguments) in enumerate(cases):
        json.loads(got[i].record)
        if arguments is not None:
            assert got[i].problem == issue
            assert got[i].record == '{"call":{"arguments":' + arguments + ',"name":"search"},"id":"c' + str(i) + '"}'


def test_types_may_be_listed():
    schema = {"type": "object", "properties": {"a": {"type": ["string", "null"]}, "b": {"type": ["integer", "number"]}, "c": {"type": "strange"}}}
    for value, issue in (
        ({"a": None}, None), ({"a": "x", "b": 1.5}, None), ({"a": 1}, "$.a: not of type string or null"),
        ({"b": True}, "$.b: not of type integer or number"), ({"c": 1}, "$.c: not of type strange"),
    ):
        assert tool_calls.problem(value, schema) == issue


def test_same_id_in_two_conversations(spark, docs):
    calls = spark.createDataFrame([(c, 1, "call_1", "search", '{"query":"q"}', None) for c in (1, 2, None, None)], CALLS)
    results = spark.createDataFrame([(1, 2, "call_1", "ra"), (2, 2, "call_1", "rb"), (None, 2, "call_1", "rc"), (2, 3, None, "rd")], RESULTS)
    got = sorted((str(r.conv_id), r.status, json.loads(r.record).get("result", "")) for r in link_calls(calls, results, SCHEMAS).collect())
    assert got == [("1", "linked", "ra"), ("2", "linked", "rb"), ("2", "orphan", "rd"), ("None", "orphan", "rc"), ("None", "unanswered", "")]


def test_empty_tables_and_other_columns(spark, docs):
    calls = spark.createDataFrame([(1, 1, "a", "search", '{"query":"q"}', None, 7, "x")], CALLS + ", level int, status string")
    results = spark.createDataFrame([(1, 2, "a", "r", 5, "y")], RESULTS + ", known_id int, record string")
    assert [r.status for r in link_calls(calls, results, SCHEMAS).collect()] == ["linked"]
    assert [r.status for r in link_calls(calls.limit(0), results, SCHEMAS).collect()] == ["orphan"]
    assert [r.status for r in link_calls(calls, results.limit(0), SCHEMAS).collect()] == ["unanswered"]
    assert link_calls(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_long_chain_and_a_ladder(spark, docs):
    """A chain takes few rounds; so does one whose calls need the two before them."""
    n = 120
    calls = spark.range(n).selectExpr("cast(1 as long) as conv_id", "cast(id as string) as call_id")
    chain = spark.range(n).selectExpr("cast(1 as long) as conv_id", "cast(id as string) as call_id", "cast(id - 1 as string) as needs")
    assert {int(r.call_id): r.level for r in tool_calls.call_levels(calls, chain).collect()} == {i: i for i in range(n)}
    few = calls.limit(0).unionByName(spark.range(20).selectExpr("cast(1 as long) as conv_id", "cast(id as string) as call_id"))
    ladder = spark.range(20).selectExpr("cast(1 as long) as conv_id", "cast(id as string) as call_id", "explode(array(id - 1, id - 2)) as n").selectExpr("conv_id", "call_id", "cast(n as string) as needs")
    assert {int(r.call_id): r.level for r in tool_calls.call_levels(few, ladder).collect()} == {i: i for i in range(20)}
