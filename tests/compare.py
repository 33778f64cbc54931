"""A query's rows against those of its SQL: same columns, same number of rows, same values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    """A value in a form in which equal ones are equal whatever made them; numbers to 9 digits."""
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or an empty string."""
    rel = con.execute(sql)
    theirs, their_rows = [c[0] for c in rel.description], rel.fetchall()
    ours = df.columns
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} against {sorted(theirs)}"
    a, b = [ours.index(c) for c in sorted(ours)], [theirs.index(c) for c in sorted(ours)]
    x = sorted((tuple(plain(r[i]) for i in a) for r in df.collect()), key=repr)
    y = sorted((tuple(plain(r[i]) for i in b) for r in their_rows), key=repr)
    if len(x) != len(y):
        return f"{len(x)} rows against {len(y)}"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} of {len(x)} rows differ, such as {bad[0]}" if bad else ""
