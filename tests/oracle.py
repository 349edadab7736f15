"""Runs a registered query and its SQL on the same tables and says how they differ."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when rows, names and values agree."""
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    at = [theirs.index(c) for c in names]
    b = sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)
    kinds = [({type(x[i]).__name__ for x in a if x[i] is not None}, {type(x[i]).__name__ for x in b if x[i] is not None}) for i in range(len(names))]
    for n, (x, y) in zip(names, kinds, strict=True):
        if x and y and x != y:
            return f"{n}: {x} and {y}"
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; {names}; only here {only[0]}; only there {only[1]}"
    return ""
