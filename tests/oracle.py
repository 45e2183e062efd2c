"""Runs a registered query and its oracle SQL on the same tables and compares row bags."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def compare(spark, con, name: str, sf: str) -> tuple[str, float]:
    from postmill.catalog import ORACLES, QUERIES

    started = time.time()
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = bag(df.select(*[f"`{c}`" for c in columns]).collect())
    took = time.time() - started
    if name not in ORACLES:
        return f"rows only: {len(mine)}", took
    rel = con.execute(ORACLES[name])
    theirs_columns = [d[0] for d in rel.description]
    order = [theirs_columns.index(c) for c in sorted(theirs_columns)]
    if sorted(theirs_columns) != columns:
        return f"COLUMNS {columns} != {sorted(theirs_columns)}", took
    theirs = bag([tuple(row[i] for i in order) for row in rel.fetchall()])
    if mine != theirs:
        extra = [m for m in mine if m not in theirs][:2]
        missing = [t for t in theirs if t not in mine][:2]
        return f"DIFF {len(mine)} vs {len(theirs)}\n  spark: {str(extra)[:900]}\n  duck : {str(missing)[:900]}", took
    return f"ok {len(mine)}", took


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from postmill.catalog import QUERIES
    from postmill.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session("oracle", "8"), duck(sf)
    for name in QUERIES:
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            text, took = compare(spark, con, name, sf)
        except Exception as exc:  # one failing query must not hide the others
            text, took = f"ERROR {str(exc)[:1500]}", 0.0
        print(f"{name:28s} {took:6.2f}s {text}", flush=True)
