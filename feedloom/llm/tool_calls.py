"""Link tool calls to their results, order them, check their arguments, write canonical JSON.

Calls and results meet in a hash join by conversation and identifier, for identifiers
are unique inside a conversation only. A call may need several earlier calls; its
level is the longest path of needs below it. Levels come from rounds that take away
needs with a known level and jump along calls with a single need left, so chains of
n calls take about log n rounds and no conversation is ever gathered in a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import stored

TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}


def text_of(value: Any) -> str:
    """JSON text; half of a surrogate pair is written as an escape."""
    return printable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def printable(text: str) -> str:
    return text.encode("utf-8", "backslashreplace").decode()


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces; a whole floating number is written as an integer."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return text_of(plain(value))


def _is(value: Any, kind: str) -> bool:
    if isinstance(value, bool) and kind in ("integer", "number"):
        return False
    return isinstance(value, TYPES.get(kind, ()))


def problem(value: Any, schema: dict, path: str = "$") -> str | None:
    """The first way in which a value breaks its schema, or None.

    Known words: type (one or a list), enum, required, properties, additionalProperties (false),
    items, minimum, maximum, minLength, maxLength, minItems, maxItems.
    """
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{path}: not of type {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{path}: under minimum"
        if value > schema.get("maximum", value):
            return f"{path}: over maximum"
    if isinstance(value, (str, list)):
        least, most = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if not schema.get(least, 0) <= len(value) <= schema.get(most, len(value)):
            return f"{path}: length out of bounds"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := problem(item, schema["items"], f"{path}[{i}]"):
                return found
    if isinstance(value, dict):
        for key in schema.get("required", []):
            if key not in value:
                return f"{path}.{key}: missing"
        known = schema.get("properties", {})
        for key in sorted(value):
            if key in known:
                if found := problem(value[key], known[key], f"{path}.{key}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{path}.{key}: not expected"
    return None


def _judge(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, str]:
    """What is wrong with a call, and its arguments as canonical JSON (as a JSON text, if they are none)."""
    try:
        value = json.loads(arguments) if arguments is not None else None
        text = canonical(value)
    except (ValueError, RecursionError):
        return "unknown tool" if name not in schemas else "arguments are not JSON", text_of(arguments)
    issue = "unknown tool" if name not in schemas else problem(value, schemas[name])
    return issue and printable(issue), text


LINKED = "conv_id long, call_id string, turn long, name string, level int, status string, problem string, result_turn long, record string"


def records(schemas: dict[str, dict]):
    """Judge the calls and write one canonical record for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                issue, parts = None, []
                if r["is_call"]:
                    issue, arguments = _judge(r["name"], r["arguments"], schemas)
                    parts.append(f'"call":{{"arguments":{arguments},"name":{text_of(r["name"])}}}')
                parts.append(f'"id":{text_of(r["call_id"])}')
                if r["is_result"]:
                    parts.append(f'"result":{text_of(r["content"])}')
                out.append({**{k: r[k] for k in ("conv_id", "call_id", "turn", "name", "level", "status", "result_turn")}, "problem": issue, "record": "{" + ",".join(parts) + "}"})
            kinds = {"conv_id": pa.int64(), "call_id": pa.string(), "turn": pa.int64(), "name": pa.string(), "level": pa.int32(), "status": pa.string(), "problem": pa.string(), "result_turn": pa.int64(), "record": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in kinds.items()], names=list(kinds))

    return run


CALL = ["conv_id", "call_id"]


def _named(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` with its first two columns as a call's key of another name."""
    return df.toDF(f"{prefix}_conv", f"{prefix}_id", *df.columns[2:])


def call_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: the longest path of needs below each call; null in a cycle or above one.

    ``calls`` has unique ``conv_id, call_id``; ``needs`` (``conv_id, call_id, needs``)
    names calls of the same conversation; ids of no call are left out, as are nulls.
    In each round a call is max(floor, level of each need + step): needs of known level
    go into the floor, and a need that itself has only one need left is replaced by
    that one.
    """
    known = calls.select(*CALL).withColumn("floor", F.lit(0).cast("long"))
    edges = needs.select(*CALL, F.col("needs").alias("need_id")).join(calls.select(*CALL), CALL, "left_semi")
    real = _named(calls.select(*CALL), "need")
    edges = edges.withColumn("need_conv", F.col("conv_id")).join(real, ["need_conv", "need_id"], "left_semi")
    edges = stored(edges.select(*CALL, "need_conv", "need_id", F.lit(1).cast("long").alias("step")).distinct(), "needs")
    floors, open_before, still = stored(known, "floors"), None, 0
    while True:
        # Calls with needs left: how many, and the only one, if it is one.
        left = edges.groupBy(*CALL).agg(
            F.count("*").alias("n"), F.first("need_conv").alias("up_conv"), F.first("need_id").alias("up_id"), F.first("step").alias("up_step")
        )
        state = stored(floors.join(left, CALL, "left"), "levels")
        n_open = state.where("n is not null").count()
        # Among calls that reach no cycle, every second round settles one at least.
        still = still + 1 if n_open == open_before else 0
        if not n_open or still > 2:
            break
        open_before = n_open
        seen = edges.join(_named(state, "need"), ["need_conv", "need_id"])
        raised = seen.where("n is null or n = 1").select(*CALL, (F.col("floor") + F.col("step")).alias("more"))
        raised = raised.groupBy(*CALL).agg(F.max("more").alias("more"))
        floors = stored(
            floors.join(raised, CALL, "left").select(*CALL, F.greatest("floor", F.coalesce("more", "floor")).alias("floor")), "floors"
        )
        jump = F.col("n") == 1
        edges = stored(
            seen.where("n is not null").select(
                *CALL,
                F.when(jump, F.col("up_conv")).otherwise(F.col("need_conv")).alias("need_conv"),
                F.when(jump, F.col("up_id")).otherwise(F.col("need_id")).alias("need_id"),
                F.when(jump, F.col("step") + F.col("up_step")).otherwise(F.col("step")).alias("step"),
            )
            .groupBy(*CALL, "need_conv", "need_id")
            .agg(F.max("step").alias("step")),
            "needs",
        )
    return state.select(*CALL, F.when(F.col("n").isNull(), F.col("floor")).cast("int").alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], needs: DataFrame | None = None) -> DataFrame:
    """One row for each call and result: ``conv_id, call_id, turn, name, level, status, problem, result_turn, record``.

    ``calls``: ``conv_id, turn, call_id, name, arguments`` (JSON text), perhaps
    ``after`` (the id of one needed call); ``results``: ``conv_id, turn, call_id,
    content``; ``needs``: ``conv_id, call_id, needs``, one row for each needed call. Ids
    count inside their conversation. ``status`` is linked, unanswered, orphan (a result
    without call) or repeated (a call whose id an earlier call of the conversation has;
    results go to the first by turn, name and arguments). Sorting by ``conv_id, level,
    turn`` is a topological order; calls in a cycle, or that need one, have no level.
    ``record`` is canonical JSON of call and result.

    Nulls: rows with a null conv_id or call_id link to nothing; null arguments are JSON
    null; a null turn comes first; a null result content stays null. Several results of
    a call give a row each; equal rows count once. Empty tables give no rows of their
    kind. Other columns are ignored.
    """
    after = F.col("after") if "after" in calls.columns else F.lit(None)
    calls = calls.select(
        F.col("conv_id").cast("long").alias("conv_id"), "call_id", F.col("turn").cast("long").alias("turn"), "name", "arguments", after.cast("string").alias("after")
    ).distinct()
    results = results.select(
        F.col("conv_id").cast("long").alias("r_conv"), F.col("call_id").alias("r_id"), F.col("turn").cast("long").alias("result_turn"), "content"
    ).distinct()
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    whole = F.struct("turn", "name", "arguments", "after")
    firsts = calls.where(named).groupBy(*CALL).agg(F.min(whole).alias("c"), F.count("*").alias("n"))
    firsts = stored(firsts.select(*CALL, "c.*", "n"), "calls")
    edges = firsts.where("after is not null").select(*CALL, F.col("after").alias("needs"))
    if needs is not None:
        edges = edges.unionByName(needs.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "needs"))
    leveled = firsts.join(call_levels(firsts, edges), CALL)
    met = (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id"))
    found = F.col("r_id").isNotNull()
    linked = leveled.join(results, met, "left").select(
        *CALL, "turn", "name", "arguments", "level", F.when(found, "linked").otherwise("unanswered").alias("status"),
        "result_turn", "content", F.lit(True).alias("is_call"), found.alias("is_result"),
    )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    orphans = results.join(_named(firsts.select(*CALL), "known"), (F.col("r_conv") == F.col("known_conv")) & (F.col("r_id") == F.col("known_id")), "left_anti")
    orphans = orphans.select(
        F.col("r_conv").alias("conv_id"), F.col("r_id").alias("call_id"), none("long", "turn"), none("string", "name"), none("string", "arguments"),
        none("int", "level"), F.lit("orphan").alias("status"), "result_turn", "content", F.lit(False).alias("is_call"), F.lit(True).alias("is_result"),
    )
    again = _named(firsts.where("n > 1").select(*CALL, F.struct("turn", "name", "arguments", "after").alias("first")), "known")
    rest = (
        calls.join(again, (F.col("conv_id") == F.col("known_conv")) & (F.col("call_id") == F.col("known_id")), "left")
        .where(~named | (F.col("known_id").isNotNull() & ~whole.eqNullSafe(F.col("first"))))
        .select(
            *CALL, "turn", "name", "arguments", none("int", "level"), F.when(named, "repeated").otherwise("unanswered").alias("status"),
            none("long", "result_turn"), none("string", "content"), F.lit(True).alias("is_call"), F.lit(False).alias("is_result"),
        )
    )
    rows = linked.unionByName(orphans).unionByName(rest)
    return rows.mapInArrow(records(schemas), LINKED)


# The tools that the query's calls are made for.
SCHEMAS = {
    "summarise": {
        "type": "object", "required": ["text", "max_words"], "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1}, "max_words": {"type": "integer", "minimum": 20}},
    },
    "search": {
        "type": "object", "required": ["query"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "maxLength": 1000}, "top_k": {"type": "integer", "minimum": 1, "maximum": 100}},
    },
    "classify": {
        "type": "object", "required": ["text", "labels"],
        "properties": {"text": {"type": "string"}, "labels": {"type": "array", "minItems": 1, "items": {"type": "string"}}},
    },
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and needs as the turns of a conversation make them.

    An assistant's turn calls a tool on its whole text, by turn in rotation, and
    needs the assistant's turn before; a user's turn is the result of the call in the
    turn before it. Ids name the turn, so they are unique inside a conversation only;
    a null turn has a null id.
    """
    called = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    turn = F.col("turn")
    tool = F.element_at(F.array(*(F.lit(x) for x in ("summarise", "search", "classify"))), (F.floor(turn / 2) % 3 + 1).cast("int"))
    size = F.length("text")
    arguments = (
        F.when(F.col("name") == "summarise", F.to_json(F.struct("text", (size % 400).alias("max_words"))))
        .when(F.col("name") == "search", F.to_json(F.struct(F.col("text").alias("query"), (size % 120).alias("top_k"))))
        .otherwise(F.to_json(F.struct("text", F.array(F.lit("question"), F.lit("answer")).alias("labels"))))
    )
    calls = (
        turns.where(F.col("role") == "assistant")
        .withColumn("name", tool)
        .select("conv_id", "turn", called(turn).alias("call_id"), "name", arguments.alias("arguments"))
    )
    results = turns.where(F.col("role") == "user").select("conv_id", "turn", called(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results, calls.select("conv_id", "call_id", called(turn - 2).alias("needs"))
