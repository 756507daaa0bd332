"""Comparison of a query with its oracle: columns by name, rows as a multiset of printed values."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(DATA, sf).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return con


def printed(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"d{v}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(printed(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    names = df.columns
    got = bag(names, df.collect())
    found = con.execute(sql)
    wanted_names = [d[0] for d in found.description]
    wanted = bag(wanted_names, found.fetchall())
    out = []
    if sorted(names) != sorted(wanted_names):
        out.append(f"columns {sorted(names)} and {sorted(wanted_names)}")
    if got != wanted:
        out.append(f"{sum(got.values())} and {sum(wanted.values())} rows; only here {list((got - wanted).items())[:2]}, only there {list((wanted - got).items())[:2]}")
    return out
