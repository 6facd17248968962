"""Registration helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.registry.views import SQL_VIEWS, Views
from feedloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the views it needs, in definition order."""
    needed: set[str] = set()

    def visit(name: str) -> None:
        for parent in SQL_VIEWS[name][0]:
            visit(parent)
        needed.add(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in SQL_VIEWS if n in needed]
    text = sql.strip()
    if not parts:
        return text
    head = ",\n".join(parts)
    if text.lower().startswith("with recursive "):
        return f"WITH RECURSIVE {head},\n{text[len('with recursive '):]}"
    if text.lower().startswith("with "):
        return f"WITH {head},\n{text[len('with '):]}"
    return f"WITH {head}\n{text}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(views) -> DataFrame`` as a named query with its SQL check."""

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, base: str) -> DataFrame:
            return fn(Views(prepare(spark), base))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register
