"""Run registered queries next to their SQL on the same tables.

``python tests/compare.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{base}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else float(f"{value:.12g}") if math.isfinite(value) else str(value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def run_both(spark, con, name: str, base: str):
    from feedloom.registry import ORACLES, QUERIES

    df = QUERIES[name](spark, base)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return ours, None
    cur = con.execute(ORACLES[name])
    return ours, canonical([d[0] for d in cur.description], cur.fetchall())


def main(argv: list[str]) -> int:
    from feedloom import build_session
    from feedloom.registry import QUERIES

    base = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(base)
    bad = 0
    for name in names:
        started = time.time()
        try:
            ours, theirs = run_both(spark, con, name, base)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:1200]}", flush=True)
            continue
        spent = time.time() - started
        if theirs is None:
            print(f"rows  {name} {len(ours[1])} {spent:.1f}s", flush=True)
        elif ours == theirs:
            print(f"ok    {name} {len(ours[1])} {spent:.1f}s", flush=True)
        else:
            bad += 1
            extra = sorted(set(map(repr, ours[1])) - set(map(repr, theirs[1])))[:3]
            missing = sorted(set(map(repr, theirs[1])) - set(map(repr, ours[1])))[:3]
            print(f"DIFF  {name} cols {ours[0]} vs {theirs[0]} rows {len(ours[1])} vs {len(theirs[1])}\n   ours {extra}\n   sql  {missing}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
