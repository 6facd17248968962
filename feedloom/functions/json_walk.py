"""Walks over JSON texts in document order, batch by batch.

VARIANT sorts the keys of an object, so the order of a document's strings is only
known to a parser that keeps it. Keys follow the order of JavaScript objects: array
indexes first, ascending, then the others as they were written; of repeated keys the
last value counts, in the place of the first.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa

_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")
_URL = re.compile(r"https?://", re.IGNORECASE)
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_LETTER = re.compile(r"[A-Za-z]")

Path = tuple[str | int, ...]


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if any(k[:1].isdigit() for k in found):
        indexes = sorted((k for k in found if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
        found = {k: found[k] for k in indexes} | {k: v for k, v in found.items() if k not in set(indexes)}
    return found


def _float(text: str) -> float | int | None:
    number = float(text)
    if math.isinf(number):
        return None
    return int(number) if number.is_integer() and abs(number) < 1e21 else number


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_float=_float, parse_constant=_no_constant)


def parse(text: str | None) -> tuple[bool, object]:
    """Whether a text is JSON, and its value; thousands of levels of nesting are none."""
    if text is None:
        return False, None
    try:
        return True, _DECODER.decode(text)
    except (ValueError, RecursionError):
        return False, None


def dump(value) -> str | None:
    """Compact JSON; half a surrogate pair is written as an escape."""
    try:
        text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        return None
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


def translatable(text: str) -> bool:
    """As ``is_translatable`` of a column: no URL, not led by a date, with a Latin letter."""
    return bool(_LETTER.search(text)) and not _URL.match(text) and not _DATE.match(text)


def strings(value, skip: frozenset[str]) -> Iterator[tuple[Path, str, Callable[[str], None] | None]]:
    """Every string outside the subtrees of skipped keys: path, text, and a setter; no setter at the top.

    Works on a stack of its own, so depth is no matter.
    """
    if isinstance(value, str):
        yield (), value, None
    todo = [((), value, _entries(value, skip))] if isinstance(value, (dict, list)) else []
    while todo:
        path, parent, entries = todo[-1]
        for step, child in entries:
            if isinstance(child, str):
                yield (*path, step), child, _setter(parent, step)
            elif isinstance(child, (dict, list)):
                todo.append(((*path, step), child, _entries(child, skip)))
                break
        else:
            todo.pop()


def _entries(node, skip: frozenset[str]) -> Iterator[tuple]:
    if isinstance(node, list):
        return iter(enumerate(node))
    return iter([(k, v) for k, v in node.items() if k not in skip])


def _setter(parent, step) -> Callable[[str], None]:
    return lambda text: parent.__setitem__(step, text)


def _utf8(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def leaf_rows(doc: str, json_col: str, skip: frozenset[str]):
    """``doc, leaf, steps, value``: the translatable strings of each document, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, paths, values = [], [], [], []
            for i, text in enumerate(batch.column(json_col).to_pylist()):
                valid, value = parse(text)
                n = 0
                for path, leaf, _ in strings(value, skip) if valid else ():
                    if translatable(leaf):
                        rows.append(i)
                        numbers.append(n)
                        paths.append([_utf8(str(step)) for step in path])
                        values.append(_utf8(leaf))
                        n += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(doc).take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(paths, pa.list_(pa.string())),
                    pa.array(values, pa.string()),
                ],
                names=[doc, "leaf", "steps", "value"],
            )

    return run


def rebuilt_rows(doc: str, json_col: str, skip: frozenset[str]):
    """``doc, rebuilt``: each document with its leaves replaced by the texts of ``changes`` (leaf, result)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, changes in zip(batch.column(json_col).to_pylist(), batch.column("changes").to_pylist()):
                valid, value = parse(text)
                if not valid:
                    out.append(None)
                    continue
                wanted = {c["leaf"]: c["result"] for c in changes or () if c["result"] is not None}
                n = 0
                for _, leaf, put in strings(value, skip) if wanted else ():
                    if translatable(leaf):
                        if n in wanted and put is None:
                            value = wanted[n]
                        elif n in wanted:
                            put(wanted[n])
                        n += 1
                out.append(dump(value))
            yield pa.RecordBatch.from_arrays([batch.column(doc), pa.array(out, pa.string())], names=[doc, "rebuilt"])

    return run
