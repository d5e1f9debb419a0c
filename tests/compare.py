"""Run a registered query and its SQL side by side and report differences."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _key(row):
    return tuple((v is None, str(type(v)), "" if v is None else str(v)) for v in row)


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    ours = [tuple(_plain(r[n]) for n in names) for r in frame.collect()]
    result = con.execute(sql)
    their_names = [d[0] for d in result.description]
    if sorted(their_names) != names:
        return [f"columns {names} vs {sorted(their_names)}"]
    places = [their_names.index(n) for n in names]
    theirs = [tuple(_plain(r[i]) for i in places) for r in result.fetchall()]
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} vs {len(theirs)}"]
    ours.sort(key=_key)
    theirs.sort(key=_key)
    found = []
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            found.append(f"{[(n, x, y) for n, x, y in zip(names, a, b) if x != y or type(x) is not type(y)]}")
    if not ours:
        found.append("no rows")
    return [f"{len(found)} rows differ", *found[:3]] if found else []
